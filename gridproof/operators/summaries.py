"""Summaries of whole runs: editing and border totals, files by category, report lines, predictions against their sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiers
from .running import along


def editing_summary(scored: DataFrame, score: str = "score") -> DataFrame:
    """One row: pictures in all, valid, for review, invalid (above 30), lightly edited (from 18); pictures without a score count as processed only."""
    s = tiers.finite(F.col(score))
    invalid, manual = F.count_if(s > 30), F.count_if((s >= 25) & (s <= 30))
    return scored.agg(F.count("*").alias("total"), (F.count("*") - invalid - manual).alias("n_valid"), invalid.alias("n_invalid"), manual.alias("n_manual"), F.count_if((s >= 18) & (s < 25)).alias("n_light"), F.count_if(s.isNull()).alias("n_unscored"))


def border_summary(found: DataFrame, confidence: str = "confidence", label: str = "label") -> DataFrame:
    """(label, n, n_invalid, n_manual, n_valid, n_high) for each kind of border."""
    c = F.col(confidence)
    return found.groupBy(label).agg(F.count("*").alias("n"), F.count_if(c >= 0.58).alias("n_invalid"), F.count_if((c >= 0.35) & (c < 0.58)).alias("n_manual"), F.count_if(c < 0.35).alias("n_valid"), F.count_if(c >= 0.85).alias("n_high"))


#: Known categories; any other is invalid. Fixed values.
CATEGORIES = ["valid", "invalid", "manual_review"]


def known_category(category: Column) -> Column:
    return F.when(category.isin(CATEGORIES), category).otherwise("invalid")


def listed(results: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, order, rank): every row's place in the list of its group, from 1, in ``order``.

    The lists are rows, not arrays, and one group may be nearly all of the table: rows are numbered along ranges of
    (by, order), and a group's first number is taken off. A null group is a list of its own.
    """
    up = along(results.select(by, *order), [by, *order], nth="_nth")
    first = up.groupBy(by).agg(F.min("_nth").alias("_first")).withColumnRenamed(by, "_by")
    return up.join(first, F.col(by).eqNullSafe(F.col("_by"))).select(by, *order, (F.col("_nth") - F.col("_first") + 1).alias("rank"))


def report_lines(results: DataFrame, filename: str = "filename", category: str = "category", reason: str = "reason") -> DataFrame:
    """(section, nth, filename, line) of a run's report: for each asset its line or, where it failed, a line for each failed check.

    Sections are 1 valid, 2 invalid, 3 manual review; the lines of a category are a distributed table, to be sorted
    by (section, filename, nth) where they are written, and never one string.
    """
    cat = known_category(F.col(category))
    section = F.when(cat == "valid", 1).when(cat == "invalid", 2).otherwise(3)
    body = F.coalesce(reason, F.lit(""))
    failed = F.when(body.startswith("Failed checks: "), F.split(F.substring(body, 16, 2**31 - 1), "; ")).otherwise(F.array(body))
    plain = F.array(F.when(section == 1, F.concat(F.lit("+ "), F.col(filename))).otherwise(F.concat(F.lit("? "), F.col(filename), F.lit(": "), body)))
    numbered = F.concat(F.array(F.concat(F.lit("x "), F.col(filename), F.lit(": Failed checks:"))), F.transform(failed, lambda p, i: F.concat(F.lit("   "), (i + 1).cast("string"), F.lit("] "), p)))
    lines = F.when(section == 2, numbered).otherwise(plain)
    return results.select(section.alias("section"), F.col(filename).alias("filename"), F.posexplode(lines).alias("nth", "line"))


def by_score(rows: DataFrame, score: str, tie: str) -> DataFrame:
    """Highest score first, rows of equal score in order of ``tie``: a distributed sort."""
    return rows.orderBy(F.desc_nulls_last(score), tie)


def manual_by_confidence(rows: DataFrame, confidence: str, tie: str) -> DataFrame:
    """Rows for manual review with their confidence as shown, with three decimals, in falling order of what is shown."""
    shown = F.round(confidence, 3)
    return rows.where((F.col(confidence) >= 0.35) & (F.col(confidence) < 0.58)).withColumn("shown", shown).orderBy(F.desc("shown"), tie)


def with_errors(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Results and error rows in one table; what one side lacks is null."""
    return results.unionByName(errors, allowMissingColumns=True)


def back_to_paths(paths: DataFrame, predictions: DataFrame, key: str = "path") -> DataFrame:
    """Every path with its prediction, by path and never by position; one without has ``error`` = ``no result``."""
    marked = predictions.withColumn("_seen", F.lit(True))
    return paths.join(marked, key, "left").withColumn("error", F.when(F.col("_seen").isNull(), "no result")).drop("_seen")


def without_source(results: DataFrame, sources: DataFrame, key: str = "filename") -> DataFrame:
    """Results with ``exists``: whether their file is among the sources."""
    there = sources.select(key).distinct().withColumn("_there", F.lit(True))
    return results.join(there, key, "left").withColumn("exists", F.col("_there").isNotNull()).drop("_there")


def folders_together(folders: dict[str, DataFrame]) -> DataFrame:
    """The listings of several folders as one table with ``folder``."""
    return reduce(DataFrame.unionByName, [rows.withColumn("folder", F.lit(name)) for name, rows in folders.items()])


def cache_stats(entries: DataFrame, size: int, now: Column) -> DataFrame:
    """One row over cache entries (at): how many, utilisation in percent of ``size``, ages in seconds of the newest and the oldest."""
    age = F.unix_timestamp(now) - F.unix_timestamp("at")
    return entries.agg(F.count("*").alias("n"), (F.count("*") * F.lit(100.0) / size).alias("utilisation"), F.min(age).alias("newest_age"), F.max(age).alias("oldest_age"))


def hit_rate(lookups: DataFrame, hit: str = "hit") -> DataFrame:
    """One row: lookups, hits, and the share of hits in percent, 0 where there were none."""
    return lookups.agg(F.count("*").alias("n"), F.count_if(F.col(hit)).alias("hits"), F.coalesce(F.try_divide(F.count_if(F.col(hit)) * F.lit(100.0), F.count("*")), F.lit(0.0)).alias("hit_rate"))


def progress(ops: DataFrame, group: str, order: list[str], took: str) -> DataFrame:
    """Running count, mean time and time left, at about every tenth of each group and at its end."""
    up = Window.partitionBy(group).orderBy(*order)
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    rows = ops.select(group, *[c for c in order if c != group], F.row_number().over(up).alias("nth"), F.avg(took).over(so_far).alias("mean_so_far"), F.count("*").over(Window.partitionBy(group)).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    return rows.where((F.col("nth") % step == 0) | (F.col("nth") == F.col("n"))).withColumn("left", F.col("mean_so_far") * (F.col("n") - F.col("nth")))


def run_progress(ops: DataFrame, order: list[str], took: str) -> DataFrame:
    """What ``progress`` shows, along the whole run as one group: (order, nth, n, mean_so_far, left), by distributed prefix sums."""
    n = ops.agg(F.count("*").alias("n"))  # one row
    up = along(ops.select(*order, took, F.col(took).isNotNull().cast("int").alias("_timed")), order, {"_took": took, "_known": "_timed"}, nth="nth")
    rows = up.join(F.broadcast(n)).withColumn("mean_so_far", F.try_divide("_took", "_known"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    shown = rows.where((F.col("nth") % step == 0) | (F.col("nth") == F.col("n")))
    return shown.select(*order, "nth", "n", "mean_so_far", (F.col("mean_so_far") * (F.col("n") - F.col("nth"))).alias("left"))


def table_line(columns: list[tuple[str, int, str]], between: str = " | ") -> Column:
    """A row as a line of a plain table: (column, width, side) of each cell, cut or filled to its width."""
    return F.concat_ws(between, *[(F.rpad if where == "left" else F.lpad)(F.coalesce(name, F.lit("")), width, " ") for name, width, where in columns])
