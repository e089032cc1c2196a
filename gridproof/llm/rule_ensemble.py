"""Quality classifier: a sparse ensemble of rules over document statistics.

Small trees are grown on a bounded sample of labelled documents; each path from a root to a node is a conjunction of
thresholds, that is, a rule. A logistic regression with an L1 penalty weights the rules (and the statistics
themselves) and leaves few; what is left is compiled into one Spark column expression that scores every document.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, shared_dir, written

STATS = [
    "n_words", "n_lines", "word_len", "long_words", "upper_share", "digit_share", "symbol_share", "punct_share", "space_share", "accent_share",
    "dup_line_share", "distinct_words", "top_word", "repeat_next", "bigram_repeat", "bar_share", "shout", "short_words", "line_words", "stop_share", "capital_words", "end_marks",
]
#: Rows at most that the trees and weights are fitted on; chosen by a hash of doc_id. Scoring covers all.
SAMPLE = 20_000
#: The most frequent words of these languages, as a sign of running text. Fixed values.
STOP = frozenset("the of and to in a is that it for on with as was by be der die und das den von zu mit sich ist des la de le et les des en un une que est el los las y se del por con".split())
SYMBOLS = "#*$%&|<>=@^~_\\{}[]+"


def statistics(text: str | None) -> list[float]:
    """The STATS of one text; all are 0 for one that is null or empty."""
    if not text:
        return [0.0] * len(STATS)
    n = len(text)
    words = text.split()
    w = len(words) or 1
    low = [x.strip(".,;:!?").lower() for x in words]
    met: dict[str, int] = {}
    for x in low:
        met[x] = met.get(x, 0) + 1
    pairs = len(set(zip(low, low[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    ascii_ = text.encode("ascii", "ignore")
    letters = ascii_.translate(None, b"0123456789 \t\n\r.,;:!?'\"()-" + SYMBOLS.encode())
    upper = len(letters) - len(letters.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(ascii_) - len(ascii_.translate(None, b"0123456789"))
    symbols = len(ascii_) - len(ascii_.translate(None, SYMBOLS.encode()))
    marks = len(ascii_) - len(ascii_.translate(None, b".,;:!?"))
    spaces = len(ascii_) - len(ascii_.translate(None, b" \t\n\r"))
    sizes = [len(x) for x in words]
    return [
        math.log1p(len(words)), math.log1p(len(lines)), sum(sizes) / w, sum(s > 12 for s in sizes) / w, upper / n, digits / n, symbols / n, marks / n, spaces / n, (n - len(ascii_)) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0, len(met) / w, max(met.values(), default=0) / w, sum(a == b for a, b in zip(low, low[1:])) / w, 1 - pairs / (w - 1) if w > 1 else 0.0,
        text.count("|") / w, text.count("!!") / w, sum(s < 3 for s in sizes) / w, w / max(len(lines), 1), sum(met.get(x, 0) for x in STOP) / w, sum(x[:1].isupper() for x in words) / w, sum(x.rstrip()[-1:] in ".!?" for x in lines) / max(len(lines), 1),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of each whole text."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(STATS))
        return {"doc_id": batch.column(0)} | {c: rows[:, i] for i, c in enumerate(STATS)}

    return by_batch(docs, ["doc_id", "text"], "doc_id long, " + ", ".join(f"{c} double" for c in STATS), work)


#: A rule: (statistic, above, threshold) of each condition; ``above`` says > instead of <=.
Rule = tuple[tuple[str, bool, float], ...]


def tree_rules(model: RandomForestClassificationModel) -> list[Rule]:
    """All paths of a forest's trees from the root to any node below it, as distinct rules, from the forest as Spark saves it.

    A forest of ``trees`` trees has fewer than trees * 2 ** (depth + 1) nodes.
    """
    spark = SparkSession.active()
    path = f"{shared_dir(spark)}/gridproof/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes: dict[int, dict[int, tuple]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split").collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r["leftChild"], r["rightChild"], r["split"]
    rules: dict[Rule, None] = {}

    def walk(tree: dict[int, tuple], at: int, path: Rule) -> None:
        if path:
            rules.setdefault(tuple(sorted(set(path))))
        left, right, split = tree[at]
        if left >= 0:
            name, cut = STATS[split["featureIndex"]], split["leftCategoriesOrThreshold"][0]
            walk(tree, left, (*path, (name, False, cut)))
            walk(tree, right, (*path, (name, True, cut)))

    for number in sorted(nodes):
        walk(nodes[number], 0, ())
    return list(rules)


def rule_column(rule: Rule) -> Column:
    held = F.lit(True)
    for name, above, cut in rule:
        held = held & ((F.col(name) > cut) if above else (F.col(name) <= cut))
    return held


class RuleEnsemble:
    """Rules and statistics with weights; ``score`` is a column expression over STATS."""

    def __init__(self, bias: float, rules: list[tuple[Rule, float]], linear: list[tuple[str, float]]):
        self.bias, self.rules, self.linear = bias, rules, linear

    def score(self) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        for name, weight in self.linear:
            total = total + F.col(name) * F.lit(float(weight))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(total, F.lit(500.0)), F.lit(-500.0))))


def fit(labelled: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.002) -> RuleEnsemble:
    """From STATS and ``label`` (0 or 1), SAMPLE rows at most. One class or no rows give a constant score."""
    seen = {int(r["label"]): r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return RuleEnsemble(3.0 if 1 in seen else -3.0 if 0 in seen else 0.0, [], [])
    rows = VectorAssembler(inputCols=STATS, outputCol="stats").transform(labelled).persist()
    try:
        forest = RandomForestClassifier(featuresCol="stats", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird").fit(rows)
        rules = tree_rules(forest)
        ruled = rows.select("label", *STATS, *[rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
        names = [*(f"r{i}" for i in range(len(rules))), *STATS]
        wide = VectorAssembler(inputCols=names, outputCol="all").transform(ruled).select("label", "all")
        lasso = LogisticRegression(featuresCol="all", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(wide)
    finally:
        rows.unpersist()
    w = lasso.coefficients.toArray()
    return RuleEnsemble(lasso.intercept, [(r, w[i]) for i, r in enumerate(rules) if w[i]], [(c, w[len(rules) + i]) for i, c in enumerate(STATS) if w[len(rules) + i]])


def held_out(folds: int = 3) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds == 1


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, and the statistics behind it.

    Learned from at most ``sample`` rows of ``labels`` (doc_id, quality) outside the held-out fold, joined to their
    texts. Null labels, labels that contradict each other for a doc_id and null doc_ids are not learned from. A null or
    empty text has statistics 0 and a score; repeated rows are scored each; an empty table gives an empty result;
    without labels of both kinds every score is the same. Other columns are neither read nor returned.
    """
    stats = written(with_statistics(docs), "statistics")
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    chosen = known.where(~held_out(folds)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("low").cast("double").alias("label"))
    learn = stats.join(chosen, "doc_id")
    model = fit(written(learn.coalesce(8), "labelled"))
    out = F.coalesce(held_out(folds), F.lit(False)).alias("held_out")
    scored = stats.withColumn("score", model.score())
    return scored.select("doc_id", out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *STATS)
