"""Failed rows, what to try on them next, and runs that go on where they were stopped.

A round asks one strategy about the rows that are still open and writes what it answered: values, and errors with the
strategy that is to try next. A round that was written is never asked again, so a run that is stopped goes on from the
rounds that are there and gives the rows of an unbroken one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of errors by words of their messages, the first that fits, and the strategy that is to try next (none: no other helps).
NEXT = [
    ("memory_exhausted", ["out of memory", "memory"], "smaller"),
    ("cuda_error", ["cuda", "gpu"], "cpu"),
    ("file_corrupted", ["no such file", "cannot identify", "corrupt", "truncated"], None),
    ("timeout_error", ["timeout", "timed out"], "quick"),
    ("channel_order", ["channel", "colour", "color"], "other_channels"),
    ("model_loading", ["weights", "model"], "other_model"),
    ("detector_unavailable", ["no module", "import", "not available", "dll"], "fallback"),
]
#: For all other errors.
OTHERWISE = ("unknown_error", "fallback")
#: What stands for a row that no strategy could do, by kind of error: status, the reason's beginning, whether the message follows it. Fixed values.
FALLBACKS = {
    "detector_unavailable": ("pass", "Detector unavailable: ", True),
    "memory_exhausted": ("pass", "Processing skipped due to memory constraints", False),
    "cuda_error": ("pass", "GPU processing failed, using CPU fallback", False),
    "file_corrupted": ("fail", "Image file corrupted or unreadable: ", True),
    "timeout_error": ("pass", "Processing timeout, using quick analysis", False),
    "unknown_error": ("pass", "Processing error: ", True),
}


def fallback_verdict(kind: Column, message: Column) -> Column:
    """struct<status, evaluation_status, reason> for a row that stays failed; kinds that have no entry are unknown errors. Null for a null kind."""
    out = None
    for name, (status, reason, told) in reversed(FALLBACKS.items()):
        text = F.concat(F.lit(reason), F.substring(F.coalesce(message, F.lit("")), 1, 100)) if told else F.lit(reason)
        found = F.struct(F.lit(status).alias("status"), F.lit("fallback").alias("evaluation_status"), text.alias("reason"))
        out = F.when(kind.isNotNull(), found) if out is None else F.when(kind == name, found).otherwise(out)
    return out


def error_kind(message: Column) -> Column:
    """struct<kind, next> of an error message; null for none."""
    low, out = F.lower(message), None
    for kind, words, then in NEXT:
        fits = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
        found = F.struct(F.lit(kind).alias("kind"), F.lit(then).cast("string").alias("next"))
        out = F.when(message.isNotNull() & fits, found) if out is None else out.when(message.isNotNull() & fits, found)
    return out.when(message.isNotNull(), F.struct(F.lit(OTHERWISE[0]).alias("kind"), F.lit(OTHERWISE[1]).alias("next")))


#: A strategy: open rows in, (key, value, error) out, with a null error where the value stands.
Strategy = Callable[[DataFrame], DataFrame]


def _round(spark: SparkSession, path: str) -> DataFrame | None:
    """A written round, or none: Spark's writers leave a mark when all of it is there."""
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").limit(1).count()
    except AnalysisException:
        return None
    return spark.read.parquet(path)


def run_with_ledger(rows: DataFrame, key: str, strategies: dict[str, Strategy], first: str, folder: str, rounds: int = 4) -> DataFrame:
    """The ledger of a run over ``rows``: (key, round, strategy, value, error, kind, next), one row for each try.

    Round 0 asks ``first`` about all rows; each later round asks, for each strategy that a failed row names, that
    strategy about those rows. A strategy that isn't there, or that the row has tried, gives way to the next one in
    the order of ``strategies`` that it has not tried; a row whose error no other helps, that has tried all, or ``rounds`` rounds, stays failed. Keys
    tell rows apart; what a strategy doesn't answer is an error "no answer". A round is one table under ``folder``,
    its keys joined back to ``rows``; an empty table has an empty ledger.
    """
    spark = rows.sparkSession
    order = list(strategies)
    open_ = rows.select(F.col(key), F.lit(first).alias("_strategy"), F.array(F.lit(first)).alias("_tried"))
    parts = []
    for n in range(rounds):
        path = f"{folder}/round-{n}"
        done = _round(spark, path)
        if done is None:
            tries = []
            for name in [first] if n == 0 else order:
                asked = open_.where(F.col("_strategy") == name)
                given = strategies[name](rows.join(asked.select(key), key, "left_semi") if n else rows).select(key, F.col("value"), F.col("error"), F.lit(True).alias("_there"))
                tries.append(asked.join(given, key, "left").withColumn("error", F.when(F.col("_there").isNull(), F.lit("no answer")).otherwise(F.col("error"))))
            met = reduce(DataFrame.unionByName, tries).withColumn("_e", error_kind(F.col("error")))
            wanted = F.concat(F.array(F.col("_e.next")), F.array(*[F.lit(x) for x in order]))
            left = F.filter(wanted, lambda x: F.array_contains(F.array(*[F.lit(y) for y in order]), x) & ~F.array_contains(F.col("_tried"), x))
            then = F.when(F.col("_e.next").isNotNull(), F.get(left, F.lit(0)))
            met.select(key, F.lit(n).alias("round"), F.col("_strategy").alias("strategy"), F.when(F.col("error").isNull(), F.col("value")).alias("value"), "error", F.col("_e.kind").alias("kind"), then.alias("next"), F.col("_tried").alias("tried")).write.mode("overwrite").parquet(path)
            done = spark.read.parquet(path)
        parts.append(done.drop("tried"))
        open_ = done.where("next IS NOT NULL").select(F.col(key), F.col("next").alias("_strategy"), F.concat("tried", F.array("next")).alias("_tried"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def outcome(ledger: DataFrame, key: str) -> DataFrame:
    """(key, value, strategy, error, n_tries, fallback): each row's last try, and the verdict that stands for one that stayed failed."""
    last = F.max_by(F.struct("value", "strategy", "error", "kind"), "round")
    rows = ledger.groupBy(key).agg(last.alias("v"), F.count("*").alias("n_tries"))
    return rows.select(key, "v.value", "v.strategy", "v.error", "n_tries", fallback_verdict(F.col("v.kind"), F.col("v.error")).alias("fallback"))
