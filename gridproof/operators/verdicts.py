"""Reconciling the verdicts of several tests on an asset.

Input is long: (asset columns, test, test_ord, status, score). Order comes from ``test_ord``, never from row arrival,
and each reconciliation is one grouping on the asset, with partial aggregation before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAIL, MANUAL, PASS = "fail", "manual", "pass"


def _is(status: str) -> Column:
    return F.col("status") == status


def run_all(verdicts: DataFrame, key: list[str], advisory: str | None = None) -> DataFrame:
    """All tests count; failures before manual review before valid.

    ``advisory``: a test whose manual review does not keep an asset from being valid. ``tests``: those behind the
    category, in order, joined by semicolons.
    """
    manual = _is(MANUAL) & (F.col("test") != advisory) if advisory else _is(MANUAL)

    def named(which: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("test_ord", "test")))), lambda s: s["test"]), ";")

    grouped = verdicts.groupBy(*key).agg(F.count_if(_is(FAIL)).alias("n_fail"), F.count_if(manual).alias("n_manual"), named(_is(FAIL)).alias("failed"), named(manual).alias("reviewed"))
    category = F.when(F.col("n_fail") > 0, "invalid").when(F.col("n_manual") > 0, "manual_review").otherwise("valid")
    return grouped.select(*key, "n_fail", "n_manual", category.alias("category"), F.when(F.col("n_fail") > 0, F.col("failed")).otherwise(F.col("reviewed")).alias("tests"))


def stop_at_first(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Tests in order, up to the first that doesn't pass: how many ran, which one stopped the run, and the category."""
    stop = F.min(F.when(~_is(PASS), F.struct("test_ord", "test", "status")))
    grouped = verdicts.groupBy(*key).agg(stop.alias("stop"), F.count("*").alias("n"), F.sort_array(F.collect_list("test_ord")).alias("ords"))
    ran = F.size(F.filter("ords", lambda o: F.col("stop").isNull() | (o <= F.col("stop.test_ord"))))
    category = F.when(F.col("stop").isNull(), "valid").when(F.col("stop.status") == MANUAL, "manual_review").otherwise("invalid")
    return grouped.select(*key, ran.alias("n_run"), F.col("stop.test").alias("stopped_by"), category.alias("category"))


def evaluated(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """The rows that a run which stops at the first test that doesn't pass looks at."""
    first = F.min(F.when(~_is(PASS), F.col("test_ord"))).over(Window.partitionBy(*key))
    return verdicts.withColumn("first", first).where(F.col("first").isNull() | (F.col("test_ord") <= F.col("first"))).drop("first")


def memberships(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """(key, category, test): where an ordered scan files each asset.

    Every failing step files it as invalid under that step; a step's manual review counts only if no earlier step
    failed; what no step has failed or filed is valid. An asset may stand in several categories.
    """
    per_asset = verdicts.groupBy(*key).agg(F.min(F.when(_is(FAIL), F.col("test_ord"))).alias("first_fail"), F.array_sort(F.collect_list(F.when(_is(FAIL) | _is(MANUAL), F.struct("test_ord", "test", "status")))).alias("marks"))
    counted = F.filter("marks", lambda m: (m["status"] == FAIL) | F.col("first_fail").isNull() | (m["test_ord"] < F.col("first_fail")))
    filed = F.transform(counted, lambda m: F.struct(F.when(m["status"] == FAIL, "invalid").otherwise("manual_review").alias("category"), m["test"].alias("test")))
    valid = F.array(F.struct(F.lit("valid").alias("category"), F.lit(None).cast("string").alias("test")))
    return per_asset.select(*key, F.explode(F.when(F.size(filed) > 0, filed).otherwise(valid)).alias("m")).select(*key, "m.category", "m.test")


def final_categories(members: DataFrame, key: list[str]) -> DataFrame:
    """One category for each asset: invalid before manual review before valid."""
    rank = F.min(F.when(F.col("category") == "invalid", 0).when(F.col("category") == "manual_review", 1).otherwise(2))
    return members.groupBy(*key).agg(rank.alias("rank"), F.count("*").alias("n_memberships")).select(*key, F.element_at(F.array(F.lit("invalid"), F.lit("manual_review"), F.lit("valid")), F.col("rank") + 1).alias("category"), "n_memberships")


def unflagged(assets: DataFrame, flags: DataFrame, key: str = "filename") -> DataFrame:
    """The assets that nothing has flagged."""
    return assets.join(flags.select(key).distinct(), key, "left_anti")


def category_counts(members: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, test, n) for every row of ``categories``, 0 where there is none."""
    counted = members.groupBy("category", F.coalesce("test", F.lit("")).alias("test")).agg(F.count("*").alias("n"))
    return F.broadcast(categories).join(counted, ["category", "test"], "left").select("category", "test", F.coalesce("n", F.lit(0)).alias("n"))


def drop_in(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """The older single verdict: valid, or the first test that doesn't pass; an unknown result is for review."""
    first = F.min(F.when(~_is(PASS), F.struct("test_ord", "test", "status"))).alias("first")
    return verdicts.groupBy(*key).agg(first).select(*key, F.col("first").isNull().alias("is_valid"), F.coalesce("first.test", F.lit("valid")).alias("category"))


ERROR, GATE = "error", "basic_validation"


def gated(verdicts: DataFrame, gate: DataFrame, key: list[str]) -> DataFrame:
    """The verdicts with basic validation (key, code) before them, as test GATE of order 0.

    Where an asset fails it, or has no row there, only that verdict is left: nothing else is looked at. Assets without
    any other verdict have the gate's alone.
    """
    first = gate.select(*key, F.lit(GATE).alias("test"), F.lit(0).alias("test_ord"), F.when(F.col("code") == "ok", PASS).otherwise(FAIL).alias("status"), F.lit(0.0).alias("score"))
    both = verdicts.select(*key, "test", "test_ord", "status", "score").unionByName(first)
    passed = F.max((F.col("test") == GATE) & _is(PASS)).over(Window.partitionBy(*key))
    return both.withColumn("_in", passed).where((F.col("test") == GATE) | F.coalesce("_in", F.lit(False))).drop("_in")


def settled_errors(verdicts: DataFrame, harmless: tuple[str, ...] = ("text",)) -> DataFrame:
    """Errors decided: a test in ``harmless`` passes, any other fails."""
    return verdicts.withColumn("status", F.when(_is(ERROR), F.when(F.col("test").isin(*harmless), PASS).otherwise(FAIL)).otherwise(F.col("status")))


#: How a run treats the tests of an asset. Fixed values.
MODES = ("parallel", "parallel_advisory", "sequential")


def by_mode(verdicts: DataFrame, gate: DataFrame, key: list[str], mode: str, advisory: str = "quality") -> DataFrame:
    """(key, category, tests) of a whole run: validation first, errors decided, then all tests (``parallel``), all with one
    that only advises, or up to the first that doesn't pass."""
    rows = settled_errors(gated(verdicts, gate, key))
    if mode == "sequential":
        return stop_at_first(rows, key).select(*key, "category", F.coalesce("stopped_by", F.lit("")).alias("tests"))
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    return run_all(rows, key, advisory if mode == "parallel_advisory" else None).select(*key, "category", "tests")


def step_numbers(text: str, steps: list[str]) -> list[str]:
    """The steps named by numbers from 1 in a text such as ``3, 1,3``: each once, in order; anything else is an error."""
    try:
        wanted = sorted({int(x) for x in text.split(",") if x.strip()})
    except ValueError:
        raise ValueError(f"not a list of numbers: {text!r}") from None
    if not wanted or wanted[0] < 1 or wanted[-1] > len(steps):
        raise ValueError(f"steps are numbered 1 to {len(steps)}")
    return [steps[i - 1] for i in wanted]


def of_steps(verdicts: DataFrame, steps: list[str]) -> DataFrame:
    """The verdicts of some steps, as a scan of only these has them."""
    return verdicts.where(F.col("test").isin(steps))


def looked_up(verdicts: DataFrame, tests: list[str], key: list[str]) -> DataFrame:
    """(key, one status column for each of ``tests`` in order), null where a test has no verdict."""
    return verdicts.groupBy(*key).agg(*[F.max(F.when(F.col("test") == t, F.col("status"))).alias(t) for t in tests])
