"""Reports over verdicts and operation logs: counts, rates, health, performance, running figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def verdict_counts(categories: DataFrame) -> DataFrame:
    """One row: totals by category and the share of valid assets in percent."""
    c = F.col("category")
    return categories.agg(
        F.count("*").alias("total"),
        F.count_if(c == "valid").alias("n_valid"),
        F.count_if(c == "manual_review").alias("n_manual"),
        F.count_if(~c.isin("valid", "manual_review")).alias("n_invalid"),
        F.coalesce(F.try_divide(F.count_if(c == "valid") * F.lit(100.0), F.count("*")), F.lit(0.0)).alias("success_rate"),
    )


def health_summary(ops: DataFrame, errors_degraded: int = 10) -> DataFrame:
    """For each component: errors, successes, its state (error above ten, degraded from one, else active), last outcome."""
    e = F.count_if(F.col("is_error"))
    return ops.groupBy("component").agg(
        e.alias("n_errors"),
        F.count_if(~F.col("is_error")).alias("n_successes"),
        F.when(e > errors_degraded, "error").when(e > 0, "degraded").otherwise("active").alias("state"),
        (e <= errors_degraded).alias("healthy"),
        F.max_by(F.col("is_error"), F.struct("ts", "event_id")).alias("last_is_error"),
    )


def health_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count_if(F.col("healthy")).alias("n_healthy"), F.count_if(~F.col("healthy")).alias("n_failed"), F.sum("n_errors").alias("n_errors"))


def performance_summary(ops: DataFrame) -> DataFrame:
    """For each kind of operation: count, mean and peak duration, operations a second of work."""
    return ops.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.avg("duration_ms").alias("mean_ms"),
        F.max("duration_ms").alias("peak_ms"),
        F.try_divide(F.count("*") * F.lit(1000.0), F.sum("duration_ms")).alias("per_second"),
    )


def performance_report(ops: DataFrame, hit: str = "hit") -> DataFrame:
    """``performance_summary`` with, for each kind of operation and for all together (null), lookups answered from a cache: n_lookups, hits, hit_rate in percent (0 without lookups)."""
    looked = F.col(hit).isNotNull()
    rate = [F.count_if(looked).alias("n_lookups"), F.count_if(F.col(hit)).alias("hits"), F.coalesce(F.try_divide(F.count_if(F.col(hit)) * F.lit(100.0), F.count_if(looked)), F.lit(0.0)).alias("hit_rate")]
    took = [F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("peak_ms"), F.try_divide(F.count("*") * F.lit(1000.0), F.sum("duration_ms")).alias("per_second")]
    return ops.groupingSets([["event_type"], []], "event_type").agg(*took, *rate)


def error_summary(ops: DataFrame) -> DataFrame:
    """One row: errors in all, components with errors, and the component with most of them (smallest on a tie)."""
    by = ops.where("is_error").groupBy("component").agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_errors"), F.count("*").alias("n_components"), F.max_by("component", F.struct("n", -F.col("component"))).alias("most_common"))


def running_progress(ops: DataFrame, every: int = 10) -> DataFrame:
    """Within each component, in order of time: running mean and count, at every tenth operation and the last."""
    order = Window.partitionBy("component").orderBy("ts", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = ops.select("component", "event_id", F.row_number().over(order).alias("nth"), F.avg("duration_ms").over(so_far).alias("mean_so_far"), F.count("*").over(Window.partitionBy("component")).alias("n"))
    return rows.where((F.col("nth") % every == 0) | (F.col("nth") == F.col("n")))


def sample_ends(rows: DataFrame, group: str, order: list[str], k: int = 5) -> DataFrame:
    """The first and last ``k`` rows of each group."""
    up, down = Window.partitionBy(group).orderBy(*order), Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("from_start", F.row_number().over(up)).withColumn("from_end", F.row_number().over(down)).where((F.col("from_start") <= k) | (F.col("from_end") <= k))


def last_by_name(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Of rows with the same name, the last."""
    others = [c for c in rows.columns if c != name]
    return rows.groupBy(name).agg(F.max_by(F.struct(*others), order).alias("last")).select(name, "last.*")


def top_k(rows: DataFrame, group: str, by: str, tie: str, k: int = 5) -> DataFrame:
    """The k largest of each group; Spark keeps k rows of a group in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def confusion(rows: DataFrame, label: str, predicted: str, classes: list[str]) -> DataFrame:
    """A row for each label with a count for each predicted class."""
    return rows.groupBy(label).pivot(predicted, classes).count().na.fill(0)


def parsed_reasons(rows: DataFrame, reason: str = "reason", prefix: str = "Failed checks: ") -> DataFrame:
    """A row for each ``name: detail`` part of a reason, in order."""
    body = F.when(F.col(reason).startswith(prefix), F.substring(F.col(reason), len(prefix) + 1, 2**31 - 1)).otherwise(F.col(reason))
    parts = rows.withColumn("part", F.split(body, "; ")).select("*", F.posexplode("part").alias("nth", "one")).drop("part")
    split = F.split("one", ": ", 2)
    return parts.select(*rows.columns, "nth", F.get(split, 0).alias("check"), F.get(split, 1).alias("detail"))


def detection_report(found: DataFrame, flagged: float = 95.0) -> DataFrame:
    """One row over detections (has, percent, seconds): totals, errors (unknown flag), shares in percent, mean time, those flagged."""
    n, has = F.count("*"), F.col("has")

    def share(x):
        return F.coalesce(F.try_divide(x * F.lit(100.0), n), F.lit(0.0))

    return found.agg(
        n.alias("total"),
        F.count_if(has).alias("n_marked"),
        F.count_if(~has).alias("n_clean"),
        F.count_if(has.isNull()).alias("n_errors"),
        share(F.count_if(has)).alias("marked_percent"),
        share(F.count_if(~has)).alias("clean_percent"),
        F.avg("seconds").alias("mean_seconds"),
        F.count_if(has & (F.col("percent") > flagged)).alias("n_flagged"),
    )


def speed_estimate(rows: DataFrame, tests: str, spent_ms: str, each_ms: float = 200.0) -> DataFrame:
    """``estimated_ms`` had every test cost ``each_ms``, the saving in percent and the factor (null where no time was spent)."""
    estimate = F.col(tests) * F.lit(each_ms)
    return rows.withColumns({"estimated_ms": estimate, "saved_percent": F.try_divide((estimate - F.col(spent_ms)) * 100, estimate), "factor": F.try_divide(estimate, F.col(spent_ms))})


def invalid_totals(members: DataFrame) -> DataFrame:
    """One row: invalid memberships over all folders, the distinct assets behind them, and whole percents of ``valid`` ones."""
    bad = F.col("category") == "invalid"
    return members.agg(
        F.count_if(bad).alias("n_listed"),
        F.count_distinct(F.when(bad, F.col("filename"))).alias("n_unique"),
        F.expr("coalesce(try_divide(count_if(category = 'valid') * 100, count(DISTINCT filename)), 0)").cast("long").alias("valid_percent"),
    )
