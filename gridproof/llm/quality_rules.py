"""Quality rules: repetition and symbol counts, and an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model over n-grams of characters, in an alphabet of the language's own: its
most frequent letters by Spark's counts, a few classes for its other letters, and one each for space, digit, mark and
symbol of any script. The order follows the alphabet, so that a sequence always fits 24 bits: four characters of 64
classes, three of 256 or two of 4096, the longest in which a thousandth of the language's letters at most share classes.
Spark counts every n-gram of every document; each language's n-grams of one order are kept as a sorted array of hashes
with arrays of log probabilities and back-off weights beside it. The hash has no collisions, and a language holds at most
2**24 n-grams of the top order, whatever the corpus.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_tables, packed, slabs, text_column, written

#: Bits of a character's class and the order of the model that goes with them; 24 bits in all.
LAYOUTS = {6: 4, 8: 3, 12: 2}
#: Share of a language's letters that may be without a class of their own.
SHARED = 0.001
#: Languages with fewer characters than this are pooled: their counts of counts are too few for discounts.
LEAST_TEXT = 10_000
#: N-grams of the models that are broadcast and used at a time (8 bytes each), or one model.
GROUP = 1 << 25
#: Counted n-grams that a task holds before it gives them out.
HELD = 1 << 22
SLAB = 500_000
SPACE, FIRST = 1, 2
_BASE: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
_TABLES: dict[tuple[int, tuple[int, ...]], np.ndarray] = {}


def letters_of(bits: int) -> int:
    """Letters that have a class of their own: classes 0 (between documents), space, digit, mark, symbol and those of other letters are apart."""
    return (1 << bits) - FIRST - 3 - others_of(bits)


def others_of(bits: int) -> int:
    return 13 if bits < 12 else 125


def base_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: its kind (l letter, s space, d digit, m mark, o other), its lower case, and a hash of that."""
    if not _BASE:
        kinds = np.full(0x110000, ord("o"), np.uint8)
        low = np.arange(0x110000, dtype=np.int32)
        for c in range(0x110000):
            ch = chr(c)
            kind = unicodedata.category(ch)[0]
            if kind in "LM":
                low[c] = ord(ch.lower()[0])
                kinds[c] = ord("l")
            elif ch.isspace():
                kinds[c] = ord("s")
            elif kind == "N":
                kinds[c] = ord("d")
            elif kind == "P":
                kinds[c] = ord("m")
        _BASE.append((kinds, low, low.astype(np.int64) * 2654435761 >> 7))
    return _BASE[0]


def class_table(bits: int, alphabet: tuple[int, ...]) -> np.ndarray:
    """The class of every code point, where the letters of ``alphabet`` have one each."""
    if (bits, alphabet) not in _TABLES:
        kinds, low, mixed = base_tables()
        top = 1 << bits
        table = np.full(0x110000, top - 1, np.uint16)
        for kind, c in (("s", SPACE), ("d", top - 3), ("m", top - 2)):
            table[kinds == ord(kind)] = c
        own = np.zeros(0x110000, np.uint16)
        own[list(alphabet)] = FIRST + np.arange(len(alphabet))
        shared = top - 3 - others_of(bits) + mixed % others_of(bits)
        _TABLES[bits, alphabet] = np.where(kinds == ord("l"), np.where(own[low] > 0, own[low], shared), table).astype(np.uint16)
    return _TABLES[bits, alphabet]


def code_points(texts: list[str | None]) -> np.ndarray:
    return np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_codes(texts: list[str | None], bits: int, alphabet: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the n-gram that ends at each character, for all texts in a row, and how many each text has."""
    sizes = np.array([len(t or "") for t in texts], np.int64)
    cls = class_table(bits, alphabet)[code_points(texts)].astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    starts = starts[sizes > 0]
    code = cls.copy()
    before = cls
    for k in range(1, LAYOUTS[bits]):  # classes further back; nothing of the text before
        before = np.concatenate([np.zeros(1, np.int32), before[:-1]])[: len(cls)]
        before[starts] = 0
        code |= before << (bits * k)
    return code, sizes


def by_model(models: list[str], texts: list[str | None]):
    """(model, places, texts) of each model in a batch, in slabs."""
    for a, b in slabs(np.array([len(t or "") for t in texts]), SLAB):
        owner = np.array(models[a:b], object)
        for m in sorted(set(models[a:b])):
            places = a + np.flatnonzero(owner == m)
            yield m, places, [texts[i] for i in places]


# --- base counts -------------------------------------------------------------------------------------------------

WHITE = b"\x20\t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        until = 0
        for i, w in enumerate(windows):
            if w in often:
                repeats += i + 3 - max(i, until)
                until = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


# --- the model ---------------------------------------------------------------------------------------------------


#: For each model its bits and its alphabet.
Layouts = dict[str, tuple[int, tuple[int, ...]]]


def alphabets(docs: DataFrame, model_of: Column) -> Layouts:
    """Each model's layout and most frequent letters, in lower case; every text counts. At most 4000 letters a model come to the driver."""

    def run(batches):
        free_tables()
        sums: dict[str, np.ndarray] = {}
        kinds, low, _ = base_tables()
        for batch in batches:
            for m, _, texts in by_model(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.bincount(code_points(texts), minlength=0x110000)
                sums[m] = sums[m] + got if m in sums else got
        for m, got in sums.items():
            got = np.bincount(low, got * (kinds == ord("l")), 0x110000).astype(np.int64)
            key = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(key), pa.string()), pa.array(key, pa.int32()), pa.array(got[key], pa.int64())], ["model", "letter", "n"])

    counted = docs.select(model_of.alias("model"), F.col("text")).mapInArrow(run, "model string, letter int, n long").groupBy("model", "letter").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("model")
    falling = by.orderBy(F.desc("n"), "letter")
    ranked = counted.select("model", "letter", F.row_number().over(falling).alias("nth"), F.sum("n").over(falling.rowsBetween(0, Window.unboundedFollowing)).alias("rest"), F.sum("n").over(by).alias("total"))
    found: dict[str, list[int]] = {}
    wide: dict[str, int] = {}  # the letters from here on may share classes
    for r in ranked.where(F.col("nth") <= letters_of(max(LAYOUTS))).orderBy("model", "nth").collect():
        found.setdefault(r["model"], []).append(r["letter"])
        if r["rest"] > SHARED * r["total"]:
            wide[r["model"]] = r["nth"]
    bits = {m: next((b for b in sorted(LAYOUTS) if wide.get(m, 0) <= letters_of(b)), max(LAYOUTS)) for m in found}
    return {m: (bits[m], tuple(x[: letters_of(bits[m])])) for m, x in found.items()}


#: The layout of a model whose texts have no letter.
PLAIN = (6, ())


def count_grams(docs: DataFrame, model_of: Column, layouts: Layouts) -> DataFrame:
    """(model, gram, n): how often each n-gram stands in all texts of each model's languages, of all models in one pass.

    A task adds up its own counts for each model and gives them out, so the shuffle carries each task's distinct
    n-grams, not their occurrences.
    """

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def given(sums: dict) -> Iterator[pa.RecordBatch]:
        for m, parts in sums.items():
            key, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(key), pa.string()), pa.array(key, pa.int32()), pa.array(n, pa.int64())], ["model", "gram", "n"])

    def run(batches):
        free_tables()
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for m, _, texts in by_model(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = sums.setdefault(m, [])
                parts.append(np.unique(gram_codes(texts, *layouts.get(m, PLAIN))[0], return_counts=True))
                if len(parts) > 1 and sum(len(k) for k, _ in parts[1:]) > max(len(parts[0][0]), SLAB // 4):
                    sums[m] = [summed(parts)]
            if sum(len(k) for parts in sums.values() for k, _ in parts) > HELD:
                yield from given(sums)
                sums = {}
        yield from given(sums)

    counted = docs.select(model_of.alias("model"), F.col("text")).mapInArrow(run, "model string, gram int, n long")
    return counted.groupBy("model", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Sorted hash arrays of one model, made from its counted n-grams of the top order.

    Order k has ``keys`` (sorted), ``logp`` and, but for the top order, ``back``: the log weight of what a context
    leaves to shorter ones. Lower orders count distinct left neighbours, as Kneser-Ney smoothing asks.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int = 5, order: int = 4):
        self.bits, self.order = bits, order
        by = np.argsort(keys)
        keys, counts = keys[by].astype(np.int64), counts[by].astype(np.float64)
        levels = {self.order: (keys, counts)}
        for k in range(self.order - 1, 0, -1):
            low, n = np.unique(levels[k + 1][0] & ((1 << (self.bits * k)) - 1), return_counts=True)
            levels[k] = (low, n.astype(np.float64))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.backs: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(1, self.order + 1):
            key, n = levels[k]
            d = self.discounts(n)
            context, start, which = np.unique(key >> self.bits, return_index=True, return_inverse=True)
            total = np.add.reduceat(n, start)
            cut = d[np.minimum(n, 3).astype(int)]
            left = np.add.reduceat(cut, start) / total
            lower = np.exp(self.log_lower(k - 1, key & ((1 << (self.bits * (k - 1))) - 1))) if k > 1 else np.full(len(key), 1 / (1 << self.bits))
            p = np.maximum(n - cut, 0) / total[which] + left[which] * lower
            self.levels.append((key.astype(np.int32), np.log(p).astype(np.float32)))
            self.backs.append((context.astype(np.int32), np.log(left).astype(np.float32)))

    @staticmethod
    def discounts(n: np.ndarray) -> np.ndarray:
        """D1, D2, D3+ at 1, 2, 3, from the counts of counts; plain values where these are too few to tell."""
        c = [float((n == i).sum()) for i in (1, 2, 3, 4)]
        if min(c) == 0:
            return np.array([0.0, 0.5, 0.75, 0.9])
        y = c[0] / (c[0] + 2 * c[1])
        return np.array([0.0, *(min(max(i - (i + 1) * y * c[i] / c[i - 1], 0.05), i - 0.05) for i in (1, 2, 3))])

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)

    def log_lower(self, k: int, code: np.ndarray) -> np.ndarray:
        """log p of the last class of each n-gram of order k, backing off where it was never seen."""
        if k == 0:
            return np.full(len(code), -np.log(1 << self.bits))
        keys, logp = self.levels[k - 1]
        at, seen = self.find(keys, code)
        out = np.where(seen, logp[at], 0.0)
        if not seen.all():
            rest = code[~seen]
            contexts, back = self.backs[k - 1]
            cat, known = self.find(contexts, rest >> self.bits)
            out[~seen] = np.where(known, back[cat], 0.0) + self.log_lower(k - 1, rest & ((1 << (self.bits * (k - 1))) - 1))
        return out

    def score(self, code: np.ndarray) -> np.ndarray:
        """log p at each position; each distinct n-gram is looked up once."""
        grams, at = np.unique(code, return_inverse=True)
        return self.log_lower(self.order, grams).astype(np.float32)[at]


def model_names(docs: DataFrame) -> list[str]:
    """The languages that get a model of their own: all with enough text."""
    size = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    rows = docs.where("lang IS NOT NULL").groupBy("lang").agg(size.alias("n")).where(F.col("n") >= LEAST_TEXT).orderBy("lang").collect()
    return [r["lang"] for r in rows]


def fit(counted: DataFrame, model: str, bits: int) -> KneserNey:
    """A model from its counted n-grams; what comes to the driver is at most one table of 2**24 counts."""
    got = counted.where(F.col("model") == model).select("gram", "n").toArrow().combine_chunks()
    return KneserNey(got["gram"].to_numpy(), got["n"].to_numpy(), bits, LAYOUTS[bits])


def model_column(own: list[str]) -> Column:
    return F.when(F.col("lang").isin(own), F.concat(F.lit("="), F.col("lang"))).otherwise(F.lit("others")) if own else F.lit("others")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{c} long" for c in BASE) + ", log_ppl double"


def answered(layouts: Layouts, fitted: dict[str, KneserNey], texts: list[str | None], models: list[str]) -> dict:
    """The columns of SCHEMA for some texts."""
    ppl = np.full(len(texts), np.nan)
    for m, places, part in by_model(models, texts):
        code, sizes = gram_codes(part, *layouts.get(m, PLAIN))
        if len(code):
            some = sizes > 0
            ppl[places[some]] = -np.add.reduceat(fitted[m].score(code).astype(np.float64), (np.cumsum(sizes) - sizes)[some]) / sizes[some]
    base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, len(BASE))
    return {c: base[:, i] for i, c in enumerate(BASE)} | {"log_ppl": [None if not t else x for t, x in zip(texts, ppl.tolist())]}


def judged(docs: DataFrame) -> list[DataFrame]:
    """(row, model, found), ``found`` a struct of SCHEMA: the rows of ``docs`` in as many tables as there are groups of models.

    All models are counted in one pass. As many as GROUP n-grams allow are fitted, broadcast and used at a time, each
    group over the rows of its languages; together the tables have all rows.
    """
    own = model_names(docs)
    model_of = model_column(own)
    layouts = alphabets(docs, model_of)
    counted = written(count_grams(docs, model_of, layouts), "grams")
    size = {r["model"]: r["n"] for r in counted.groupBy("model").agg(F.count("*").alias("n")).collect()}
    names = [*[f"={x}" for x in own], "others"]
    rows = packed(docs, "text", "lang").withColumn("model", model_of)
    parts = []
    for a, b in slabs(np.array([size.get(m, 0) for m in names]), GROUP):
        group = names[a:b]
        sent = docs.sparkSession.sparkContext.broadcast(({m: layouts[m] for m in group if m in layouts}, {m: fit(counted, m, layouts.get(m, PLAIN)[0]) for m in group if m in size}))
        found = text_column(SCHEMA, lambda texts, models, sent=sent: answered(*sent.value, texts, models))
        parts.append(rows.where(F.col("model").isin(group)).select("row", "model", found(F.col("text"), F.col("model")).alias("found")))
    return parts


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, model, base counts and log perplexity of each document, written in the shared folder, one group of models after another."""
    parts = [written(part.select("row.doc_id", "model", "found.*"), "quality") for part in judged(docs.select("doc_id", "text", "lang"))]
    return reduce(DataFrame.unionByName, parts)


def failed(n_words: Column, n_repeat_words: Column, min_words: int, max_repeat_percent: int) -> Column:
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat_percent * n_words)


def bands(scored: DataFrame, below: float, above: float) -> DataFrame:
    """(model, low, high): the median log perplexity of documents that pass the base rules, less ``below`` and plus ``above`` robust deviations.

    The percentiles are exact over values rounded to thousandths, of which there are a bounded number.
    """
    value = F.round("log_ppl", 3)
    p = scored.where("NOT base_failed").groupBy("model").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    wide = F.greatest((F.col("p")[2] - F.col("p")[0]) / 1.349, F.lit(0.02))
    return p.select("model", (F.col("p")[1] - below * wide).alias("low"), (F.col("p")[1] + above * wide).alias("high"))


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, below: float = 5.0, above: float = 10.0) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ppl, ppl_low, ppl_high.

    Fails the base rules: fewer words than ``min_words``, or more than ``max_repeat_percent`` of the words in repeated
    3-word windows. Rejected besides: a perplexity outside the band of the document's language. A null or empty text
    has no words and fails; null languages and those with fewer than LEAST_TEXT characters share one model; where no
    document of a model passes the base rules there is no band (nulls) and perplexity rejects nothing; repeated rows
    are judged each by itself; an empty table gives an empty result. The upper side is the wider one, since a document
    that mixes languages is less likely under either language's model and still sound. A document is scored by a model
    that counted it too: leaving its own counts out would need its n-grams beside the model's at every place, and moves
    a document only where it is a good part of its language's text, for which there is LEAST_TEXT. Other columns of
    ``docs`` are neither read nor returned.
    """
    scored = measured(docs).withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words"), min_words, max_repeat_percent))
    band = F.broadcast(bands(scored, below, above))  # a row for each model
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return scored.join(band, "model", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "log_ppl", F.col("low").alias("ppl_low"), F.col("high").alias("ppl_high")
    )


def rows_in_bands(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, below: float = 5.0, above: float = 10.0) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, each judged by itself; no column of ``docs`` can clash.

    Texts are scored once for the bands and once more for the verdict, instead of being shuffled for a join. Null and empty
    texts have no words and go (unless ``min_words`` is 0); an empty table stays one.
    """
    parts = judged(docs)
    fails = failed(F.col("found.n_words"), F.col("found.n_repeat_words"), min_words, max_repeat_percent)
    seen = reduce(DataFrame.unionByName, [p.select("model", "found.log_ppl", fails.alias("base_failed")) for p in parts])
    band = written(bands(seen, below, above), "bands")
    inside = F.coalesce(F.col("found.log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return reduce(DataFrame.unionByName, [p.join(F.broadcast(band), "model", "left").where(~fails & inside).select("row.*") for p in parts])
