"""Pixels brought to another size: a centre crop, then areas where a picture shrinks and cubic interpolation where it grows.

Both are taken apart into rows and columns. Areas come from running sums at fractional places, so a pixel costs the same
however many it covers. Sizes are column arithmetic (``functions.sizes``); pixels are worked on in the task that has the row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sizes

#: How sharp the cubic is. Fixed value.
SHARP = -0.75


def by_area(x: np.ndarray, n: int) -> np.ndarray:
    """The first axis in ``n`` equal parts, each the mean over the part of it that it covers."""
    step = x.shape[0] / n
    at = np.minimum(np.arange(n + 1) * step, x.shape[0])
    whole = np.minimum(at.astype(np.int64), x.shape[0] - 1)
    sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    upto = sums[whole] + (at - whole).reshape(-1, *[1] * (x.ndim - 1)) * x[whole]
    return np.diff(upto, axis=0) / step


def by_cubic(x: np.ndarray, n: int) -> np.ndarray:
    """The first axis at ``n`` places, by the four nearest values; edge values repeat."""
    at = (np.arange(n) + 0.5) * x.shape[0] / n - 0.5
    first = np.floor(at).astype(np.int64)
    t = at - first

    def near(d: np.ndarray) -> np.ndarray:
        return ((SHARP + 2) * d - (SHARP + 3)) * d * d + 1

    def far(d: np.ndarray) -> np.ndarray:
        return ((SHARP * d - 5 * SHARP) * d + 8 * SHARP) * d - 4 * SHARP

    weights = (far(1 + t), near(t), near(1 - t), far(2 - t))
    return sum(w.reshape(-1, *[1] * (x.ndim - 1)) * x[np.clip(first + k - 1, 0, x.shape[0] - 1)] for k, w in enumerate(weights))


def resized(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bytes (rows, columns and maybe channels) at another size: areas if neither side grows, else cubic; halves go up."""
    h, w = picture.shape[:2]
    if (h, w) == (height, width):
        return picture
    way = by_area if width <= w and height <= h else by_cubic
    out = way(np.swapaxes(way(picture.astype(np.float64), height), 0, 1), width)
    return np.clip(np.floor(np.swapaxes(out, 0, 1) + 0.5 + 1e-9), 0, 255).astype(np.uint8)


def resampled(pictures: DataFrame, to: Column, crop: Column | None = None) -> DataFrame:
    """``pictures`` (width, height, gray, and maybe rgb: binary) at the size ``to``, a struct of width and height.

    ``crop``, a struct of x, y, width and height, is cut out first. A null or impossible size, bytes that don't fit
    theirs or are null: bytes are null, with the size that was asked for. Other columns stay and do not leave the JVM.
    """
    coloured = "rgb" in pictures.columns
    kind = pa.struct([("gray", pa.binary()), ("rgb", pa.binary())])

    def one(w: int | None, h: int | None, to: dict | None, cut: dict | None, *planes: bytes | None) -> dict:
        out: list[bytes | None] = [None, None]
        if None not in (w, h) and to and min(to["width"] or 0, to["height"] or 0) > 0:
            x, y, cw, ch = (cut["x"], cut["y"], cut["width"], cut["height"]) if cut else (0, 0, w, h)
            for i, (plane, channels) in enumerate(zip(planes, ((), (3,)))):
                if plane is not None and len(plane) == w * h * (3 if channels else 1) and cw > 0 and ch > 0:
                    part = np.frombuffer(plane, np.uint8).reshape(h, w, *channels)[y : y + ch, x : x + cw]
                    out[i] = resized(part, to["width"], to["height"]).tobytes()
        return dict(zip(("gray", "rgb"), out))

    def answer(*columns: pa.Array) -> pa.Array:
        return pa.array([one(*[v.as_py() for v in r]) for r in zip(*columns)], type=kind)

    def plain(w: pa.Array, h: pa.Array, t: pa.Array, c: pa.Array, a: pa.Array) -> pa.Array:
        return answer(w, h, t, c, a)

    def tinted(w: pa.Array, h: pa.Array, t: pa.Array, c: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return answer(w, h, t, c, a, b)

    made = F.arrow_udf(tinted if coloured else plain, "struct<gray: binary, rgb: binary>").asNondeterministic()
    cut = F.lit(None).cast("struct<x: int, y: int, width: int, height: int>") if crop is None else crop
    there = [c for c in pictures.columns if c not in ("width", "height", "gray", "rgb")]
    packed = pictures.select(F.struct(*[pictures[f"`{c}`"] for c in there]).alias("rest") if there else F.lit(None).alias("rest"), to.alias("to"), made("width", "height", to, cut, "gray", *(["rgb"] if coloured else [])).alias("v"))
    return packed.select(*[F.col(f"rest.`{c}`").alias(c) for c in there], F.col("to.width").alias("width"), F.col("to.height").alias("height"), F.col("v.gray").alias("gray"), *([F.col("v.rgb").alias("rgb")] if coloured else []))


def sums(width: str, gray: str) -> Column:
    """struct<sum, by_x, by_y> of a picture's bytes: their sum, and this with each one times its column or row, from 1. Null where there is none."""
    fields = [(c, pa.int64()) for c in ("sum", "by_x", "by_y")]

    def one(w: int | None, plane: bytes | None) -> dict | None:
        if not w or plane is None or len(plane) % w:
            return None
        g = np.frombuffer(plane, np.uint8).reshape(-1, w)
        rows, columns = g.sum(1, dtype=np.int64), g.sum(0, dtype=np.int64)
        return {"sum": int(rows.sum()), "by_x": int(columns @ np.arange(1, w + 1)), "by_y": int(rows @ np.arange(1, len(g) + 1))}

    def added(widths: pa.Array, planes: pa.Array) -> pa.Array:
        return pa.array([one(w.as_py(), p.as_py()) for w, p in zip(widths, planes)], type=pa.struct(fields))

    return F.arrow_udf(added, "struct<sum: long, by_x: long, by_y: long>").asNondeterministic()(width, gray)


def for_text(pictures: DataFrame) -> DataFrame:
    """Pictures as a text recogniser gets them (``sizes.text_input``): about the middle, in its range of sizes.

    Adds ``text_ok``: whether the result fits; one that does not keeps its row, with null bytes.
    """
    channels = F.when(F.col("rgb").isNotNull(), 3).otherwise(1) if "rgb" in pictures.columns else F.lit(1)
    wanted = sizes.text_input(F.col("width"), F.col("height"), channels)
    w, h = F.col("width"), F.col("height")
    crop = F.struct(wanted["crop_x"].alias("x"), wanted["crop_y"].alias("y"), F.least(w, h * 20).cast("int").alias("width"), F.least(h, w * 20).cast("int").alias("height"))
    to = F.when(wanted["ok"], F.struct(wanted["width"].alias("width"), wanted["height"].alias("height")))
    marked = pictures.withColumn("text_ok", F.coalesce(wanted["ok"], F.lit(False)))
    return resampled(marked, to, crop)


def for_hard_pictures(pictures: DataFrame) -> DataFrame:
    """Pictures that a recogniser failed on, as they are tried again: the longer side 2000 at most, then the shorter one 32 at least."""
    one = resampled(pictures, sizes.longest_within(F.col("width"), F.col("height"), 2000))
    return resampled(one, sizes.shortest_from(F.col("width"), F.col("height"), 32))
