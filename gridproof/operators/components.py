"""Connected parts of picture masks as Spark jobs: runs of pixels, links between neighbouring runs, components, boxes.

A mask is kept as runs: (image, y, x0, x1), both ends included, in the coordinates of the whole picture. A picture may come in
tiles, each with the place of its corner: runs that touch across a tile's edge are linked as any others are. Runs of
neighbouring rows meet by an interval join over bins of columns; components are found over all pictures together, and areas
and boxes are plain sums. No outline is traced, and no picture is held whole by a task. Where the tiles are at hand, ``tile_components``
joins runs within a tile in the task that has it, so that only parts that reach a tile's edge are linked by Spark.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .contours import labelled
from .links import components

#: Columns of a bin: two runs are compared only if they reach into one bin.
BIN = 64


def mask_runs(tiles: DataFrame, mask: Callable[[np.ndarray], np.ndarray], key: str = "image") -> DataFrame:
    """(key, y, x0, x1) of the pixels where ``mask`` of a tile's gray levels is true.

    ``tiles`` has width, height, gray (binary) and, for tiles of larger pictures, left and top. A tile without bytes, or
    whose bytes don't fit its size, has no runs.
    """
    fields = [(c, pa.int32()) for c in ("y", "x0", "x1")]

    def one(w: int | None, h: int | None, gray: bytes | None) -> list[dict]:
        if None in (w, h, gray) or not w or len(gray) != w * h:
            return []
        on = np.pad(mask(np.frombuffer(gray, np.uint8).reshape(h, w)).astype(np.int8), ((0, 0), (1, 1)))
        y, x0 = np.nonzero(np.diff(on, axis=1) == 1)
        _, x1 = np.nonzero(np.diff(on, axis=1) == -1)
        return [{"y": a, "x0": b, "x1": c - 1} for a, b, c in zip(y.tolist(), x0.tolist(), x1.tolist())]

    def runs(w: pa.Array, h: pa.Array, gray: pa.Array) -> pa.Array:
        return pa.array([one(*r) for r in zip(*(c.to_pylist() for c in (w, h, gray)))], type=pa.list_(pa.struct(fields)))

    found = F.arrow_udf(runs, "array<struct<y: int, x0: int, x1: int>>").asNondeterministic()
    left, top = (F.col(c) if c in tiles.columns else F.lit(0) for c in ("left", "top"))
    flat = tiles.select(key, left.alias("left"), top.alias("top"), F.explode(found("width", "height", "gray")).alias("r"))
    return flat.select(key, (F.col("r.y") + F.col("top")).alias("y"), (F.col("r.x0") + F.col("left")).alias("x0"), (F.col("r.x1") + F.col("left")).alias("x1"))


def run_links(runs: DataFrame, key: str = "image", corners: bool = True) -> DataFrame:
    """(a, b): the ids of runs (id, key, y, x0, x1) that touch, side by side in a row or in neighbouring rows; ``corners`` says whether corners touch."""
    reach = 1 if corners else 0

    def binned(rows: DataFrame, low: Column, high: Column) -> DataFrame:
        return rows.withColumn("bin", F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN))))

    a = runs.select(F.col("id").alias("a"), F.col(key).alias("k"), F.col("y").alias("ay"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    # a run looks for others in its own row just after it, and in the next row
    wanted = a.select("*", F.explode(F.array(F.struct(F.col("ay").alias("y"), (F.col("a1") + 1).alias("from"), (F.col("a1") + 1).alias("to")), F.struct((F.col("ay") + 1).alias("y"), (F.col("a0") - reach).alias("from"), (F.col("a1") + reach).alias("to")))).alias("w")).select("a", "k", "w.*")
    near = binned(wanted, F.col("from"), F.col("to"))
    there = binned(runs.select(F.col("id").alias("b"), F.col(key).alias("k"), "y", "x0", "x1"), F.col("x0"), F.col("x1"))
    met = near.join(there, ["k", "y", "bin"]).where((F.col("x0") <= F.col("to")) & (F.col("x1") >= F.col("from")))
    first = F.floor(F.greatest("from", "x0") / BIN)  # the first bin that both reach into
    return met.where(F.col("bin") == first).select("a", "b")


def mask_components(runs: DataFrame, key: str = "image", corners: bool = True) -> DataFrame:
    """(key, part, n_pixels, x, y, width, height) of each connected part of ``runs`` (key, y, x0, x1), the parts of a picture
    numbered from 1 by their first pixel, row by row. Runs of one picture may not overlap. A null key is a picture of its own."""
    told = written(runs.select(F.monotonically_increasing_id().alias("id"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), key, "y", "x0", "x1"), "runs")
    roots = components(run_links(told.select("id", F.struct(F.col(key).isNull().alias("none"), "k").alias("k"), "y", "x0", "x1"), "k", corners))
    named = told.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    size = (F.col("x1") - F.col("x0") + 1).cast("long")
    return _numbered(named.select(key, "root", size.alias("n"), F.struct("y", "x0").alias("first"), "x0", "x1", F.col("y").alias("y0"), F.col("y").alias("y1")), key)


def _numbered(named: DataFrame, key: str) -> DataFrame:
    """The parts of ``mask_components`` from what belongs to them: (key, root, n, first, x0, x1, y0, y1)."""
    found = named.groupBy(key, "root").agg(
        F.sum("n").alias("n_pixels"), F.min("x0").alias("x"), F.min("y0").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("width"), (F.max("y1") - F.min("y0") + 1).alias("height"), F.min("first").alias("first"),
    )
    nth = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    return found.select(key, nth.alias("part"), "n_pixels", "x", "y", "width", "height")


def tile_parts(tiles: DataFrame, mask: Callable[[np.ndarray], np.ndarray], key: str = "image", corners: bool = True) -> DataFrame:
    """(key, n, first, x0, x1, y0, y1, rim) of each connected part within a tile of ``tiles`` (as for ``mask_runs``).

    ``first`` is its first pixel, ``rim`` the runs by which it reaches the tile's edge; all places are those of the whole picture.
    """
    kind = "array<struct<n: long, first: struct<y: int, x0: int>, x0: int, x1: int, y0: int, y1: int, rim: array<struct<y: int, x0: int, x1: int>>>>"

    def one(w: int | None, h: int | None, gray: bytes | None, left: int, top: int) -> list[dict]:
        if None in (w, h, gray) or not w or len(gray) != w * h:
            return []
        on = mask(np.frombuffer(gray, np.uint8).reshape(h, w)).astype(bool)
        turn = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (y, x0), x1 = np.nonzero(turn == 1), np.nonzero(turn == -1)[1] - 1
        edge = (y == 0) | (y == h - 1) | (x0 == 0) | (x1 == w - 1)
        found: dict[int, dict] = {}
        for part, a, b, c, out in zip(labelled(on, corners)[y, x0].tolist(), (y + top).tolist(), (x0 + left).tolist(), (x1 + left).tolist(), edge.tolist()):
            p = found.setdefault(part, {"n": 0, "first": {"y": a, "x0": b}, "x0": b, "x1": c, "y0": a, "rim": []})
            p |= {"n": p["n"] + c - b + 1, "x0": min(p["x0"], b), "x1": max(p["x1"], c), "y1": a}
            if out:
                p["rim"].append({"y": a, "x0": b, "x1": c})
        return list(found.values())

    def parts(*columns: pa.Array) -> pa.Array:
        return pa.array([one(*[v.as_py() for v in r]) for r in zip(*columns)], type=made)

    run = pa.struct([(c, pa.int32()) for c in ("y", "x0", "x1")])
    made = pa.list_(pa.struct([("n", pa.int64()), ("first", pa.struct([("y", pa.int32()), ("x0", pa.int32())])), *[(c, pa.int32()) for c in ("x0", "x1", "y0", "y1")], ("rim", pa.list_(run))]))
    left, top = (F.col(c).cast("int") if c in tiles.columns else F.lit(0) for c in ("left", "top"))
    found = F.arrow_udf(parts, kind).asNondeterministic()
    return tiles.select(key, F.explode(found("width", "height", "gray", left, top)).alias("_part")).select(key, "_part.*")


def tile_components(tiles: DataFrame, mask: Callable[[np.ndarray], np.ndarray], key: str = "image", corners: bool = True) -> DataFrame:
    """As ``mask_components`` of the runs of ``tiles``, which may not overlap: parts within tiles are nodes, and only the runs at tiles' edges are joined."""
    told = written(tile_parts(tiles, mask, key, corners).withColumn("id", F.monotonically_increasing_id()), "parts")
    # a null key is a picture of its own
    picture = F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"))
    roots = components(run_links(told.select("id", picture.alias("k"), F.inline("rim")), "k", corners))
    named = told.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    return _numbered(named.select(key, "root", "n", "first", "x0", "x1", "y0", "y1"), key)


def frame_candidates(parts: DataFrame, pictures: DataFrame, key: str = "image", most: int = 5, least_area: float = 0.1, most_area: float = 0.9) -> DataFrame:
    """(key, part, x, y, width, height, area, hollow, score, rank): the parts of each picture that may be a frame, best first.

    A candidate's box covers ``least_area`` to ``most_area`` of the picture (a box that is the whole picture counts as
    ``most_area``); the ``most`` largest stay. The score is for being hollow (few of the box's pixels are its own), in the
    middle, and of the picture's proportions; the first of equal scores has rank 1.
    """
    sized = parts.join(pictures.select(key, F.col("width").alias("w"), F.col("height").alias("h")), key)
    area = F.least(F.lit(most_area), F.col("width") * F.col("height") / (F.col("w") * F.col("h")))
    hollow = 1 - F.col("n_pixels") / (F.col("width") * F.col("height"))
    off = F.abs(F.col("x") + F.col("width") / 2 - F.col("w") / 2) / F.col("w") + F.abs(F.col("y") + F.col("height") / 2 - F.col("h") / 2) / F.col("h")
    shape = (F.col("width") / F.col("height")) / (F.col("w") / F.col("h"))
    score = 0.5 * hollow + 0.25 * F.greatest(F.lit(0.0), 1 - 2 * off) + 0.25 * F.least(shape, 1 / shape)
    rated = sized.select(key, "part", "x", "y", "width", "height", area.alias("area"), hollow.alias("hollow"), score.alias("score")).where(F.col("area") >= least_area)
    large = Window.partitionBy(key).orderBy(F.desc("area"), "part")
    kept = rated.withColumn("_nth", F.row_number().over(large)).where(F.col("_nth") <= most).drop("_nth")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "part")))
