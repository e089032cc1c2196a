"""Joins over hot keys and connected components, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: A key with more than one in so many rows is joined by itself: there are never more such keys than this.
HUBS = 1000
#: Fewer rows than this are no hot key, however small the table.
LEAST_HUB = 256


def hot_keys(counted: DataFrame, key: str, total: int) -> list:
    """The values of ``key`` that hold more than one in HUBS of ``total`` rows, from (key, n); at most HUBS of them."""
    return [r[0] for r in counted.where(F.col("n") > max(total // HUBS, LEAST_HUB)).select(key).collect()]


def hub_join(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """``left`` and ``right`` (one row for each key) joined on ``key``; the rows of the ``hot`` keys stay where they are.

    At most HUBS rows of ``right`` belong to hot keys, and these are broadcast; all other keys are joined by shuffle.
    """
    if not hot:
        return left.join(right, key)
    near = left.where(F.col(key).isin(hot)).join(F.broadcast(right.where(F.col(key).isin(hot))), key)
    return near.unionByName(left.where(~F.col(key).isin(hot)).join(right.where(~F.col(key).isin(hot)), key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a long, b long), root the smallest node of its component.

    Alternating large and small stars; each star is a written table, so that neither lineage nor driver memory grows,
    and the links of a hub (the centre of a large group) are not shuffled to one task. Loops and repeated links are
    fine; nulls are not allowed.
    """

    def star(e: DataFrame, total: int, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        joined = hub_join(both, least.select("a", "m"), "a", hot_keys(least, "a", total))
        moved = joined.where("b > a").selectExpr("b AS a", "m AS b") if large else joined.selectExpr("b AS a", "m AS b").union(least.selectExpr("a", "m AS b"))
        return written(moved.where("a <> b").distinct(), "stars")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = mark(now)
    while seen[0]:
        now = star(star(now, seen[0], True), seen[0], False)
        if (new := mark(now)) == seen:
            break
        seen = new
    return now.selectExpr("a AS node", "b AS root").union(now.selectExpr("b AS node", "b AS root").distinct())
