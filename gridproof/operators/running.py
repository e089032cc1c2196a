"""Figures along one order of a whole table, by distributed prefix sums.

A window without PARTITION BY is one task. Here the rows are dealt into ranges of the order and sorted within them; each
range is numbered and summed by itself, and what the ranges before it add up to (a row for each range) is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: A row number within a range has so many bits in Spark's increasing ids.
BITS = 33


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def ranged(rows: DataFrame, order: list[Column | str], at: str, ranges: int | None = None) -> DataFrame:
    """``rows`` in ranges of ``order``, written, with ``at``: the range's number above BITS bits of place within it."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranged")


def along(rows: DataFrame, order: list[Column | str], sums: dict[str, str] | None = None, nth: str = "nth", ranges: int | None = None) -> DataFrame:
    """``rows`` with ``nth`` (from 1, in ``order``) and, for each name in ``sums``, the running sum of that column up to the row.

    ``order`` should tell all rows apart: rows that are equal in it fall in one range, in any order. A null adds
    nothing to a sum, and a sum is null until its first value, as in SQL. An empty table gives an empty one.
    """
    at = _free("_at", rows.columns)
    part, before = _free("_range", rows.columns), _free("_before", rows.columns)
    told = ranged(rows, order, at, ranges).withColumn(part, F.shiftright(at, BITS).cast("int"))
    totals = told.groupBy(part).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate((sums or {}).values())])
    up = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select(F.col(part).alias(before), F.coalesce(F.sum("n").over(up), F.lit(0)).alias(f"{before}n"), *[F.sum(f"s{i}").over(up).alias(f"{before}{i}") for i in range(len(sums or {}))])
    joined = told.join(F.broadcast(offsets), F.col(part) == F.col(before))
    added = {nth: F.col(at).bitwiseAND((1 << BITS) - 1) + F.col(f"{before}n") + 1}
    within = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    for i, (name, c) in enumerate((sums or {}).items()):
        own = F.sum(c).over(within)
        added[name] = F.coalesce(own + F.col(f"{before}{i}"), own, F.col(f"{before}{i}"))
    return joined.withColumns(added).drop(at, part, before, f"{before}n", *[f"{before}{i}" for i in range(len(sums or {}))])
