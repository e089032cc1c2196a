"""Features of whole pictures of any size in one pass: a row for each picture, measured in the task that reads it.

``measured`` gives each picture's sums (histograms, means and deviations of strips, steps at block borders) as a struct;
every rule over them is a column expression. Nothing is shuffled, and the rows carry their own width and height.
``operators/pixels.py`` has the same rules over a table of pixels, as the slow form that this one is held against.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scores import fallback_editing_score
from . import contours, kernels
from .pixels import FRAME_SHARES, REGION_SHARES, WEIGHTS, WIDTH_SHARES, histogram_scores, mean_of, spread_of, unit

SIDES = ("top", "bottom", "left", "right")
_RIM = "struct<w: int, rim: double, dev: double, inside: double, centre: double, m: array<double>, d: array<double>, corners: array<double>, edge: double>"
_TONE = "struct<w: int, dev: double, line: double, out: array<double>, mid: array<double>>"
#: What each part of the measures holds.
PARTS = {
    "hist": "hist array<long>, mean double, deviation double, texture double",
    "rims": f"obvious array<{_RIM}>, simple array<{_RIM}>, region array<{_RIM}>, five {_RIM}, strip {_RIM}, edge {_RIM}",
    "even": "even_share double",
    "blocks": "lines_h array<double>, lines_v array<double>",
    "shade": "shade array<double>",
    "sides": "sides array<array<long>>",
    "slope": "slope_rim double, slope_mid double",
    "kernels": kernels.FEATURES,
    "frames": contours.FEATURES,
    "colour": f"entropy double, n_peaks long, tones array<{_TONE}>, steps array<double>",
    # what the plain tests need of the parts above, at a fraction of their cost
    "edge": f"edge {_RIM}",
    "levels": "entropy double, n_peaks long",
}


class Sums:
    """Sums of a picture's rectangles, from one table of running sums: four numbers a rectangle. Whole numbers stay exact."""

    def __init__(self, values: np.ndarray, squares: bool = True):
        self.values = values
        self.tables = [self.summed(values)] + ([self.summed(values.astype(np.int64 if values.dtype.kind in "iu" else np.float64) ** 2)] if squares else [])

    @staticmethod
    def summed(values: np.ndarray) -> np.ndarray:
        out = np.zeros((values.shape[0] + 1, values.shape[1] + 1), np.int64 if values.dtype.kind in "iu" else np.float64)
        np.cumsum(values, axis=0, dtype=out.dtype, out=out[1:, 1:])
        np.cumsum(out[1:, 1:], axis=1, out=out[1:, 1:])
        return out

    def box(self, y0: int, y1: int, x0: int, x1: int) -> tuple:
        """(number, sum, sum of squares) of rows y0 to y1 and columns x0 to x1, the ends not included."""
        h, w = self.values.shape
        y0, y1, x0, x1 = (min(max(v, 0), most) for v, most in ((y0, h), (y1, h), (x0, w), (x1, w)))
        y1, x1 = max(y0, y1), max(x0, x1)
        return (y1 - y0) * (x1 - x0), *[(t[y1, x1] - t[y0, x1] - t[y1, x0] + t[y0, x0]).item() for t in self.tables]

    def cells(self, grid: int) -> np.ndarray:
        """The deviation of each cell of a grid, what is left over at the right and below not included."""
        ch, cw = self.values.shape[0] // grid, self.values.shape[1] // grid
        s, q = (np.diff(np.diff(t[: ch * grid + 1 : ch, : cw * grid + 1 : cw], axis=0), axis=1).astype(np.float64) for t in self.tables)
        n = ch * cw
        return np.sqrt(np.maximum(n * q - s * s, 0)) / n


def less(a: tuple, b: tuple) -> tuple:
    return tuple(x - y for x, y in zip(a, b))


def mean(part: tuple) -> float | None:
    return float(part[1] / part[0]) if part[0] else None


def deviation(part: tuple) -> float | None:
    n, s, q = part
    return math.sqrt(max(n * q - s * s, 0)) / n if n else None


def middle(w: int, width: int, height: int) -> tuple[int, int, int, int]:
    """The rectangle that a border of ``w`` pixels encloses, both ends of ``w`` and size less ``w`` included."""
    return w, height - w + 1, w, width - w + 1


def rim(gray: Sums, slope: Sums, w: int, width: int, height: int) -> dict:
    """Means and deviations of a border of ``w`` pixels: the drawn line's inner half, the four sides, corners, the step inside."""
    whole, half, c = gray.box(0, height, 0, width), w // 2, min(2 * w, 15)
    drawn = less(whole, gray.box(half + 1, height - half, half + 1, width - half))
    sides = [gray.box(0, w, 0, width), gray.box(height - w, height, 0, width), gray.box(0, height, 0, w), gray.box(0, height, width - w, width)]
    corners = [gray.box(*v, *h) for v in ((0, c), (height - c, height)) for h in ((0, c), (width - c, width))]
    outline = less(slope.box(w - 2, height - w + 3, w - 2, width - w + 3), slope.box(w + 1, height - w, w + 1, width - w))
    return {
        "w": w, "rim": mean(drawn), "dev": deviation(drawn), "inside": mean(gray.box(*middle(w, width, height))), "centre": mean(gray.box(w, height - w, w, width - w)),
        "m": [mean(s) for s in sides], "d": [deviation(s) for s in sides], "corners": [mean(s) for s in corners], "edge": mean(outline),
    }


def rims(gray: Sums, slope: Sums, width: int, height: int) -> dict:
    shorter, known = min(width, height), {}

    def of(w: int) -> dict:
        if w not in known:
            known[w] = rim(gray, slope, w, width, height)
        return known[w]

    return {
        "obvious": [of(w) for w in range(3, min(shorter // 10, 20) + 1)],
        "simple": [of(w) for w in sorted({max(2, int(shorter * s)) for s in WIDTH_SHARES})],
        "region": [of(w) for w in sorted({int(shorter * s) for s in REGION_SHARES}) if w >= 2],
        "five": of(5),
        "strip": of(int(shorter * 0.05)),
        "edge": of(edge_width(shorter)),
    }


def edge_width(shorter: int) -> int:
    return max(1, min(20, shorter // 20))


def edge_rim(gray: Sums, width: int, height: int) -> dict:
    """The four sides of the border that the plain test looks at, without what the others need of one."""
    w = edge_width(min(width, height))
    sides = [gray.box(0, w, 0, width), gray.box(height - w, height, 0, width), gray.box(0, height, 0, w), gray.box(0, height, width - w, width)]
    return {"w": w, "m": [mean(s) for s in sides], "d": [deviation(s) for s in sides]}


def even_share(gray: Sums, grid: int = 8) -> float | None:
    return float((gray.cells(grid) < 8).mean()) if min(gray.values.shape) >= grid else None


def block_lines(g: np.ndarray, block: int = 8) -> list[float]:
    """The mean step across each border of blocks, but for the last."""
    at = np.arange(block, g.shape[0] - block, block)
    return np.abs(g[at] - g[at - 1]).mean(axis=1).tolist()


def shade(gray: Sums, width: int, height: int) -> list[float | None]:
    """Means of a square about the middle and of the four corners."""
    r, c = min(width, height) // 4, min(width, height) // 8
    square = gray.box(height // 2 - r, height // 2 + r + 1, width // 2 - r, width // 2 + r + 1)
    return [mean(square), *[mean(gray.box(*v, *h)) for v in ((0, c + 1), (height - c, height)) for h in ((0, c + 1), (width - c, width))]]


def side_histograms(g: np.ndarray, share: float = 0.15) -> list[list[int]]:
    t, (h, w) = int(min(g.shape) * share), g.shape
    return [np.bincount(s.ravel() // 4, minlength=64).tolist() for s in (g[:t], g[h - t :], g[:, :t], g[:, w - t :])]


def half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def tones_of(rgb: np.ndarray) -> list[np.ndarray]:
    """Gray, hue, saturation, value, lightness and the two colour axes of each pixel, as ``pixels.hsv`` and ``pixels.lab`` have them."""
    r, g, b = (rgb[:, :, k].astype(np.float64) for k in range(3))
    top, span = rgb.max(2).astype(np.float64), (rgb.max(2).astype(np.int64) - rgb.min(2)).astype(np.float64)
    some = np.where(span == 0, 1, span)
    turn = np.where(span == 0, 0, np.where(top == r, (g - b) * 60 / some, np.where(top == g, (b - r) * 60 / some + 120, (r - g) * 60 / some + 240)))
    hue = half_up(np.where(turn < 0, turn + 360, turn) / 2) % 180
    from .pixels import XYZ

    u = rgb / 255.0
    lin = np.where(u > 0.04045, ((u + 0.055) / 1.055) ** 2.4, u / 12.92)
    xyz = {k: (lin[:, :, 0] * p + lin[:, :, 1] * q + lin[:, :, 2] * s) / white for k, (p, q, s, white) in XYZ.items()}
    f = {k: np.where(t > 0.008856, t ** (1 / 3), t * 7.787 + 16 / 116) for k, t in xyz.items()}
    light = np.where(xyz["Y"] > 0.008856, f["Y"] * 116 - 16, xyz["Y"] * 903.3)
    return [half_up(r * 0.299 + g * 0.587 + b * 0.114), hue, np.where(top == 0, 0, half_up(span * 255 / np.where(top == 0, 1, top))), top, half_up(light * 255 / 100), half_up((f["X"] - f["Y"]) * 500 + 128), half_up((f["Y"] - f["Z"]) * 200 + 128)]


def levels(rgb: np.ndarray) -> dict:
    """The mean entropy of the three channels' histograms, and how many levels are more frequent than both beside them."""
    n = np.stack([np.bincount(rgb[:, :, k].ravel(), minlength=256) for k in range(3)])
    share = n / (rgb.shape[0] * rgb.shape[1])
    return {"entropy": float(-(share * np.log2(share + 1e-10)).sum(1).sum() / 3), "n_peaks": int(((n[:, 1:-1] > n[:, :-2]) & (n[:, 1:-1] > n[:, 2:])).sum())}


def colour(rgb: np.ndarray) -> dict:
    (h, w), shorter = rgb.shape[:2], min(rgb.shape[:2])
    parts = [Sums(t) for t in tones_of(rgb)]

    def outside(s: Sums, border: int) -> tuple:
        half = border // 2
        return less(s.box(0, h, 0, w), s.box(half + 1, h - half, half + 1, w - half))

    tones = []
    for border in sorted({v for s in FRAME_SHARES if (v := int(shorter * s)) >= 1}):
        inset = max(1, border // 2)
        near = inset // 2
        line = less(parts[0].box(border - near, h - border + near + 1, border - near, w - border + near + 1), parts[0].box(border + near + 1, h - border - near, border + near + 1, w - border - near))
        drawn = [outside(s, border) for s in parts]
        tones.append({"w": border, "dev": deviation(drawn[0]), "line": mean(line), "out": [mean(d) for d in drawn], "mid": [mean(s.box(*middle(border + inset, w, h))) for s in parts]})
    flat = [Sums(rgb[:, :, k].astype(np.int64)) for k in range(3)]
    steps = [(mean(outside(s, 5)), mean(s.box(*middle(5, w, h)))) for s in flat]
    return levels(rgb) | {"tones": tones, "steps": [None if None in s else abs(s[0] - s[1]) for s in steps]}


def measures(g: np.ndarray, rgb: np.ndarray | None, parts: tuple[str, ...]) -> dict:
    """The measures of one gray picture (whole numbers) and, if there are any, its colours."""
    (h, w), gray, out = g.shape, Sums(g), {}
    slope = Sums(kernels.slopes(g), squares=False) if {"rims", "slope"} & set(parts) else None
    if "hist" in parts:
        whole = gray.box(0, h, 0, w)
        out |= {"hist": np.bincount(g.ravel(), minlength=256).tolist(), "mean": mean(whole), "deviation": deviation(whole), "texture": float(kernels.laplacian(g).mean())}
    if "rims" in parts:
        out |= rims(gray, slope, w, h)
    if "even" in parts:
        out["even_share"] = even_share(gray)
    if "blocks" in parts:
        out |= {"lines_h": block_lines(g), "lines_v": block_lines(g.T)}
    if "shade" in parts:
        out["shade"] = shade(gray, w, h)
    if "sides" in parts:
        out["sides"] = side_histograms(g)
    if "slope" in parts:
        inner = slope.box(*middle(int(min(w, h) * 0.15), w, h))
        out |= {"slope_rim": mean(less(slope.box(0, h, 0, w), inner)), "slope_mid": mean(inner)}
    edges = kernels.canny(g) if {"kernels", "frames"} & set(parts) else None
    if "kernels" in parts:
        out |= kernels.features(g, edges)
    if "frames" in parts:
        out |= contours.features(g.astype(np.float64), edges)
    if "edge" in parts and "rims" not in parts:
        out["edge"] = edge_rim(gray, w, h)
    if rgb is not None and {"colour", "levels"} & set(parts):
        out |= colour(rgb) if "colour" in parts else levels(rgb)
    return out


def measured(pictures: DataFrame, *parts: str) -> DataFrame:
    """``pictures`` (width, height, gray: binary row by row, and for colour rgb: binary, three bytes a pixel) with ``m``.

    ``m`` is a struct of the named PARTS. It is null for a picture whose bytes are null, do not fit its size, or that
    has a side under 3 pixels. Other columns stay as they are and do not leave the JVM.
    """
    named = {f.name: f for p in parts for f in StructType.fromDDL(PARTS[p])}  # parts may share measures
    schema = StructType(list(named.values()))
    fields = list(to_arrow_schema(schema))
    coloured = bool({"colour", "levels"} & set(parts))

    def one(w: int | None, h: int | None, gray: bytes | None, rgb: bytes | None) -> dict | None:
        if w is None or h is None or gray is None or w < 3 or h < 3 or len(gray) != w * h:
            return None
        tints = np.frombuffer(rgb, np.uint8).reshape(h, w, 3) if rgb is not None and len(rgb) == 3 * w * h else None
        return measures(np.frombuffer(gray, np.uint8).reshape(h, w).astype(np.int32), tints, parts)

    def answers(*columns: pa.Array) -> pa.Array:
        # a picture at a time: bytes of a whole batch would be there twice
        rows = [one(*[v.as_py() for v in r]) for r in zip(*columns)]
        return pa.array(rows, type=pa.struct(fields))

    def plain(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return answers(a, b, c, pa.nulls(len(a)))

    def tinted(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return answers(a, b, c, d)

    measure = F.arrow_udf(tinted if coloured else plain, schema).asNondeterministic()  # or the planner would run it twice
    return pictures.withColumn("m", measure("width", "height", "gray", *(["rgb"] if coloured else [])))


# --- rules over the measures: columns of structs ------------------------------------------------------------------


def m(name: str) -> Column:
    return F.col(f"m.{name}")


def shorter() -> Column:
    return F.least("width", "height")


def side(r: Column, what: str) -> dict[str, Column]:
    return {s: F.get(r[what], i) for i, s in enumerate(SIDES)}


def histogram_features(measured: DataFrame, key: str = "image") -> DataFrame:
    """As ``pixels.histogram_features``; parts: hist."""
    return histogram_scores(measured.where("m IS NOT NULL").select(F.col(key), shares().alias("p")), key)


def shares() -> Column:
    """The histogram as shares of the picture's pixels; parts: hist."""
    total = F.col("width").cast("long") * F.col("height")  # a sum of the histogram would be taken again for each level
    return F.transform(m("hist"), lambda n: n / total)


def best(rated: Column, none: Column) -> Column:
    """The struct with the highest score, the narrowest among equals; ``none`` where there is no candidate."""
    return F.array_max(F.concat(F.array(none), rated))


def obvious(contrast: Column | float = 25.0, steady: float = 15.0) -> Column:
    """struct<border_width, n_sides, confidence, detected> of the plain border test (``pixels.obvious_border``); parts: rims."""
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("w"), F.lit(0).alias("n"))
    contrast = F.lit(contrast) if isinstance(contrast, float) else contrast

    def rate(r: Column) -> Column:
        mean_, dev = side(r, "m"), side(r, "d")
        diff = {s: F.abs(mean_[s] - r["centre"]) for s in SIDES}
        on = {s: (diff[s] > contrast) & (dev[s] < steady) for s in SIDES}
        n = sum((on[s].cast("int") for s in SIDES), F.lit(0))
        away = mean_of(list(diff.values()))
        score = away / contrast * unit(F.lit(1.0) - mean_of(list(dev.values())) / 30)
        for a, b in (("top", "bottom"), ("left", "right")):
            score = score * F.when(on[a] & on[b], F.lit(1.0) - F.least(F.lit(1.0), F.abs(mean_[a] - mean_[b]) / (away + 1e-5))).otherwise(1.0)
        opposite = (on["top"] & on["bottom"]) | (on["left"] & on["right"])
        score = score * F.when(n == 4, 1.5).when(n == 3, 1.2).when((n == 2) & opposite, 1.1).otherwise(1.0)
        return F.when((n > 0) & (score > 0), F.struct(score.alias("score"), (-r["w"]).alias("w"), n.alias("n"))).otherwise(none)

    b = best(F.transform(m("obvious"), rate), none)
    confidence = F.least(F.lit(1.0), b["score"] / 3)
    return F.struct((-b["w"]).alias("border_width"), b["n"].alias("n_sides"), confidence.alias("confidence"), ((b["n"] >= 2) & (confidence > 0.6)).alias("detected"))


def border_scores(r: Column, all_dev: Column) -> dict[str, Column]:
    sides, corners = side(r, "m"), [F.get(r["corners"], i) for i in range(4)]
    return {
        "uniformity": F.lit(1.0) - F.least(F.lit(1.0), r["dev"] / F.greatest(F.lit(5.0), all_dev) / 2),
        "side_consistency": F.lit(1.0) - F.least(F.lit(1.0), spread_of(list(sides.values())) / 400),
        "corner_consistency": F.when(r["w"] < 4, 0.8).otherwise(F.lit(1.0) - F.least(F.lit(1.0), spread_of(corners) / 200)),
    }


def statistics() -> Column:
    """struct<uniformity, side_consistency, corner_consistency> of a border of five pixels; parts: hist, rims."""
    return F.struct(*[c.alias(n) for n, c in border_scores(m("five"), m("deviation")).items()])


def vignetting() -> Column:
    """struct<ratio, score, vignetted> (``pixels.vignette``); parts: shade."""
    centre, four = F.get(m("shade"), 0), [F.get(m("shade"), i) for i in range(1, 5)]
    ratio = centre / (mean_of(four) + 1e-5)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio - 1) * (F.lit(1.0) - F.sqrt(spread_of(four)) / (mean_of(four) + 1e-5)))
    return F.struct(ratio.alias("ratio"), score.alias("score"), ((score > 0.3) & (ratio > 1.2)).alias("vignetted"))


def simple(contrast: Column | float = 30.0, widest: float = 0.15, least: float = 0.35, dark: Column | None = None) -> Column:
    """struct<border_width, difference, score, detected> of the width search (``pixels.simple_border``); parts: hist, rims, shade."""
    contrast = F.lit(contrast) if isinstance(contrast, float) else contrast
    low = m("deviation") < 30
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("w"), F.lit(0.0).alias("difference"))

    def rate(r: Column) -> Column:
        parts = border_scores(r, m("deviation"))
        away = F.abs(r["rim"] - r["inside"])
        fit = (away >= contrast / 2) & (parts["uniformity"] >= 0.75) & (parts["side_consistency"] >= 0.70)
        parts |= {"contrast": F.least(F.lit(1.0), away / contrast), "uniformity": F.greatest(F.lit(0.0), (parts["uniformity"] - 0.5) * 2), "transition": F.when(r["w"] > 2, F.least(F.lit(1.0), r["edge"] / 30)).otherwise(0.5)}
        ratio = r["w"] / shorter()
        factor = F.when(ratio > widest / 2, F.greatest(F.lit(0.7), F.lit(1.0) - (ratio - widest / 2) * 3)).otherwise(1.0)
        score = sum((parts[k] * v for k, v in WEIGHTS.items()), F.lit(0.0)) * factor * F.when(low, 0.9).otherwise(1.0)
        return F.when(fit, F.struct(score.alias("score"), (-r["w"]).alias("w"), away.alias("difference"))).otherwise(none)

    b = best(F.transform(m("simple"), rate), none)
    bar, dark = F.when(low, least * 1.2).otherwise(least), vignetting() if dark is None else dark
    over = b["score"] > bar
    veto = over & dark["vignetted"] & (dark["score"] > 0.6) & (b["score"] < bar * 1.5)
    return F.struct((-b["w"]).alias("border_width"), b["difference"].alias("difference"), (b["score"] * F.when(veto, 0.8).otherwise(1.0)).alias("score"), (over & ~veto).alias("detected"))


def region(contrast: float = 30.0) -> Column:
    """struct<border_width, regions> (``pixels.border_region``); parts: rims."""
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("w"))

    def rate(r: Column) -> Column:
        away = F.abs(r["rim"] - r["inside"])
        score = away * (F.lit(1.0) - F.least(F.lit(1.0), r["dev"] / 30))
        return F.when((away > contrast / 2) & (score > 0), F.struct(score.alias("score"), (-r["w"]).alias("w"))).otherwise(none)

    b, zero = -best(F.transform(m("region"), rate), none)["w"], F.lit(0)
    w, h = F.col("width"), F.col("height")

    def box(name: str, *ends: Column) -> Column:
        return F.struct(F.lit(name).alias("side"), *[v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), ends)])

    boxes = F.array(box("top", zero, zero, w, b), box("bottom", zero, h - b, w, h), box("left", zero, zero, b, h), box("right", w - b, zero, w, h))
    return F.struct(b.alias("border_width"), F.filter(boxes, lambda r: b > 0).alias("regions"))


def uniform() -> Column:
    """struct<score, uniform> (``pixels.uniform_background``); parts: even, rims."""
    even = F.when(m("strip.w") > 0, mean_of([F.lit(1.0) - F.least(F.lit(1.0), d / 20) for d in side(m("strip"), "d").values()])).otherwise(0.0)
    score = m("even_share") * 0.6 + even * 0.4
    return F.struct(score.alias("score"), (score > 0.7).alias("uniform"))


def blockiness() -> Column:
    """struct<horizontal, vertical, score, blocky> (``pixels.block_artifacts``); parts: blocks."""

    def stats(lines: Column) -> tuple[Column, Column]:
        n = F.nullif(F.size(lines), F.lit(0))
        mean_ = F.aggregate(lines, F.lit(0.0), lambda s, x: s + x) / n
        return mean_, F.sqrt(F.aggregate(lines, F.lit(0.0), lambda s, x: s + (x - mean_) * (x - mean_)) / n)

    (h, dev_h), (v, dev_v) = stats(m("lines_h")), stats(m("lines_v"))
    regular = [F.when(dev > 1e-9, mean_ / (dev + 1e-5)).otherwise(0.0) for mean_, dev in ((h, dev_h), (v, dev_v))]
    score = F.least(F.lit(1.0), (regular[0] + regular[1]) / 10)
    return F.struct(h.alias("horizontal"), v.alias("vertical"), score.alias("score"), F.coalesce((score > 0.3) & ((h > 2) | (v > 2)), F.lit(False)).alias("blocky"))


def edge_strips() -> Column:
    """struct<variance, bordered> (``pixels.edge_strips``); parts: edge, or rims."""
    variance = mean_of([d * d for d in side(m("edge"), "d").values()])
    return F.struct(variance.alias("variance"), (variance < 200).alias("bordered"))


def sides() -> Column:
    """struct<least_uniformity, side_consistency, symmetry, sharpness> (``pixels.side_measures``); parts: rims."""
    mean_, dev = side(m("five"), "m"), side(m("five"), "d")
    even = [F.lit(1.0) - F.least(F.lit(1.0), d / 30) for d in dev.values()]
    alike = F.when(mean_of(even) > 0, F.lit(1.0) - F.sqrt(spread_of(even)) / mean_of(even)).otherwise(1.0)
    level = [F.lit(1.0) - F.least(F.lit(1.0), F.abs(mean_[a] - mean_[b]) / 50) for a, b in (("top", "bottom"), ("left", "right"))]
    return F.struct(F.least(*even).alias("least_uniformity"), alike.alias("side_consistency"), mean_of(level).alias("symmetry"), F.least(F.lit(1.0), m("five.edge") / 50).alias("sharpness"))


def symmetry(bins: int = 64) -> Column:
    """struct<score, symmetric> (``pixels.border_symmetry``); parts: sides."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def correlation(i: int, j: int) -> Column:
        a, b = F.get(m("sides"), i), F.get(m("sides"), j)
        sa, sb = total(a), total(b)
        top = total(F.zip_with(a, b, lambda x, y: (x * y).cast("double"))) - sa * sb / bins
        below = (total(F.transform(a, lambda x: (x * x).cast("double"))) - sa * sa / bins) * (total(F.transform(b, lambda x: (x * x).cast("double"))) - sb * sb / bins)
        return F.when(below > 1e-9, top / F.sqrt(below)).otherwise(1.0)

    score = mean_of([correlation(0, 1), correlation(2, 3)])
    return F.struct(score.alias("score"), (score > 0.7).alias("symmetric"))


def slope_ratio() -> Column:
    """struct<ratio, framed> (``pixels.gradient_ratio``); parts: slope."""
    ratio = m("slope_rim") / (F.coalesce(m("slope_mid"), F.lit(0.0)) + 1e-10)
    return F.struct(ratio.alias("ratio"), (ratio > 1.5).alias("framed"))


def colour_consistency() -> Column:
    """As ``pixels.colour_consistency``; parts: colour."""
    steps = [F.get(m("steps"), i) for i in range(3)]
    middle_ = mean_of(steps)
    return F.when(middle_ > 0, F.lit(1.0) - F.least(F.lit(1.0), spread_of(steps) / (middle_ * middle_))).otherwise(0.0)


def fallback_editing() -> Column:
    """struct<entropy, n_peaks, score, passed> (``pixels.fallback_editing``); parts: levels, or colour."""
    value, n = m("entropy"), m("n_peaks")
    score = fallback_editing_score(value, n)
    return F.struct(value.alias("entropy"), n.alias("n_peaks"), score.cast("double").alias("score"), (score < 20).alias("passed"))


def colour_frame(contrast: float = 30.0) -> Column:
    """struct<difference, confidence, detected> (``pixels.colour_frame``); parts: colour."""
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("w"), F.lit(0.0).alias("difference"))

    def rate(r: Column) -> Column:
        gray, hue, *rest = [F.abs(F.get(r["out"], i) - F.get(r["mid"], i)) for i in range(7)]
        away = F.greatest(F.abs(F.get(r["out"], 0) - r["line"]), gray)
        even = F.lit(1.0) - F.least(F.lit(1.0), r["dev"] / 40)
        others = [F.least(hue, F.lit(180.0) - hue) / 90, *[d / most for d, most in zip(rest, (128, 128, 100, 127, 127))]]
        score = F.greatest(away / contrast * (even * 0.5 + 1), *[F.least(F.lit(1.5), o) for o in others])
        return F.when(score > 0, F.struct(score.alias("score"), (-r["w"]).alias("w"), away.alias("difference"))).otherwise(none)

    b = best(F.transform(m("tones"), rate), none)
    return F.struct(b["difference"].alias("difference"), F.least(F.lit(1.0), b["score"] / 2).alias("confidence"), (b["score"] > 1).alias("detected"))
