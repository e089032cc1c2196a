"""Picture features over a pixel table (image, x, y, gray) in DataFrame functions only.

This is the slow form, a row for each pixel: ``operators/pictures.py`` has the same rules in one pass over whole pictures and
is held against it. Every feature is one or two groupings by image, with partial sums before the shuffle: a picture's pixels need not meet
in one task. ``size`` is (width, height), or columns that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import fallback_editing_score


def histogram_features(pixels: DataFrame) -> DataFrame:
    """Clipping in percent, entropy in bits, smoothness, local peaks of at least a tenth of the largest bin, distance from uniform."""
    hist = pixels.groupBy("image", "gray").agg(F.count("*").alias("n"))
    bins = F.sequence(F.lit(0), F.lit(255))
    packed = hist.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("gray", F.col("n").cast("double")))).alias("h"), F.sum("n").cast("double").alias("total"))
    full = packed.select("image", F.transform(bins, lambda b: F.coalesce(F.try_element_at("h", b), F.lit(0.0)) / F.col("total")).alias("p"))
    return histogram_scores(full, "image")


def histogram_scores(full: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` and the features of the histogram in ``p``: shares of the 256 levels."""
    zero, p = F.lit(0.0), F.col("p")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, lambda s, x: s + x)

    diff = F.transform(F.sequence(F.lit(1), F.lit(255)), lambda i: F.get(p, i) - F.get(p, i - 1))
    entropy = -total(F.transform(p, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(zero)))
    steps = F.col("steps")  # equal neighbours once, so that a flat top is one peak
    peaks = F.size(F.filter(F.sequence(F.lit(0), F.lit(255)), lambda i: (F.get(steps, i) > F.get(steps, i - 1)) & (F.get(steps, i) > F.get(steps, i + 1)) & (F.get(steps, i) >= F.col("top") * 0.1)))
    ks = F.aggregate(
        F.sequence(F.lit(0), F.lit(255)),
        F.struct(zero.alias("c"), zero.alias("m")),
        lambda s, i: F.struct((s["c"] + F.get(p, i)).alias("c"), F.greatest(s["m"], F.abs(s["c"] + F.get(p, i) - (i + 1) / F.lit(256.0))).alias("m")),
    )["m"]
    with_diff = full.withColumns({"d": diff, "top": F.array_max(p)}).withColumn("steps", F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))))
    mean = total(F.col("d")) / 255
    var = total(F.transform("d", lambda x: x * x)) / 255 - mean * mean
    return with_diff.select(
        *kept,
        (F.get(p, 0) * 100).alias("black_clipping"),
        (F.get(p, 255) * 100).alias("white_clipping"),
        ((F.get(p, 0) + F.get(p, 255)) * 100).alias("total_clipping"),
        entropy.alias("entropy"),
        (F.lit(1.0) / (F.lit(1.0) + var)).alias("smoothness"),
        peaks.cast("long").alias("n_peaks"),
        ks.alias("ks"),
    )


SIDES = ("top", "bottom", "left", "right")


def strips(width: int, height: int, w: int) -> dict[str, Column]:
    """Whether a pixel is in the strip of ``w`` pixels along each side."""
    x, y = F.col("x"), F.col("y")
    return {"top": y < w, "bottom": y >= height - w, "left": x < w, "right": x >= width - w}


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def mean_of(xs: list[Column]) -> Column:
    return sum(xs[1:], xs[0]) / len(xs)


def spread_of(xs: list[Column]) -> Column:
    """Population variance of a few columns."""
    mean = mean_of(xs)
    return mean_of([(x - mean) * (x - mean) for x in xs])


def obvious_border(pixels: DataFrame, width: int = 64, height: int = 64, contrast: float = 25.0, steady: float = 15.0) -> DataFrame:
    """The plain border test: for each candidate width, sides that differ from what they enclose and are even.

    Candidates are 3 to a tenth of the shorter side (20 at most). A side counts if its mean differs from the enclosed
    part's by more than ``contrast`` and its deviation is below ``steady``. The score is contrast and evenness of all
    four sides, symmetry of opposite sides that both count, and completeness; the best candidate (the narrowest among
    equals) is a border if two sides count and its confidence is above 0.6. ``border_width`` is 0 where no side counts.
    """
    x, y, g = F.col("x"), F.col("y"), F.col("gray")
    widths = [w for w in range(3, min(min(width, height) // 10, 20) + 1)]
    within = F.least(x, y, F.lit(width - 1) - x, F.lit(height - 1) - y)
    aggs = []
    for w in widths:
        aggs.append(F.avg(F.when(within >= w, g)).alias(f"c_{w}"))
        for side, inside in strips(width, height, w).items():
            aggs += [F.avg(F.when(inside, g)).alias(f"m_{side}_{w}"), F.stddev_pop(F.when(inside, g)).alias(f"s_{side}_{w}")]
    one = pixels.groupBy("image").agg(*aggs or [F.count("*").alias("n")])
    scored = [F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("w"), F.lit(0).alias("n"))]
    for w in widths:
        mean, dev = ({s: F.col(f"{k}_{s}_{w}") for s in SIDES} for k in "ms")
        diff = {s: F.abs(mean[s] - F.col(f"c_{w}")) for s in SIDES}
        on = {s: (diff[s] > contrast) & (dev[s] < steady) for s in SIDES}
        n = sum((on[s].cast("int") for s in SIDES), F.lit(0))
        away = mean_of(list(diff.values()))
        even = unit(F.lit(1.0) - mean_of(list(dev.values())) / 30)
        score = away / contrast * even
        for a, b in (("top", "bottom"), ("left", "right")):
            score = score * F.when(on[a] & on[b], F.lit(1.0) - F.least(F.lit(1.0), F.abs(mean[a] - mean[b]) / (away + 1e-5))).otherwise(1.0)
        opposite = (on["top"] & on["bottom"]) | (on["left"] & on["right"])
        score = score * F.when(n == 4, 1.5).when(n == 3, 1.2).when((n == 2) & opposite, 1.1).otherwise(1.0)
        scored.append(F.when((n > 0) & (score > 0), F.struct(score.alias("score"), F.lit(-w).alias("w"), n.alias("n"))).otherwise(scored[0]))
    best = F.array_max(F.array(*scored))
    confidence = F.least(F.lit(1.0), F.col("b.score") / 3)
    return one.select("image", best.alias("b")).select("image", (-F.col("b.w")).alias("border_width"), F.col("b.n").alias("n_sides"), confidence.alias("confidence"), ((F.col("b.n") >= 2) & (confidence > 0.6)).alias("detected"))


def uniform_background(pixels: DataFrame, width: int = 64, height: int = 64, grid: int = 8) -> DataFrame:
    """Even surroundings: the share of grid cells with a deviation below 8, and how even the strips at the four sides are.

    The strips are a twentieth of the shorter side wide; a picture too small for them has none and gets nothing for them.
    """
    cw, ch, w = width // grid, height // grid, int(min(width, height) * 0.05)
    cells = pixels.where((F.col("x") < cw * grid) & (F.col("y") < ch * grid)).groupBy("image", F.floor(F.col("x") / cw).alias("cx"), F.floor(F.col("y") / ch).alias("cy")).agg(F.stddev_pop("gray").alias("dev"))
    shares = cells.groupBy("image").agg((F.count_if(F.col("dev") < 8) / F.count("*")).alias("share"))
    sides = pixels.groupBy("image").agg(*[F.stddev_pop(F.when(inside, F.col("gray"))).alias(s) for s, inside in strips(width, height, w).items()])
    even = mean_of([F.lit(1.0) - F.least(F.lit(1.0), F.col(s) / 20) for s in SIDES]) if w else F.lit(0.0)
    out = shares.join(sides, "image").select("image", (F.col("share") * 0.6 + even * 0.4).alias("score"))
    return out.select("image", "score", (F.col("score") > 0.7).alias("uniform"))


def block_artifacts(pixels: DataFrame, width: int = 64, height: int = 64, block: int = 8) -> DataFrame:
    """Steps across the borders of 8-pixel blocks: their mean in each direction, and a score for how regular they are.

    Regularity is the mean over the deviation of a direction's block borders (none where they are all alike). Only
    the pixels beside a border are grouped: the two of a pair by a signed sum.
    """
    x, y, g = F.col("x"), F.col("y"), F.col("gray")

    def beside(across: Column, along: Column, size: int, name: str) -> Column:
        line = F.floor((across + 1) / block)
        sign = F.when(across % block == 0, g).when(across % block == block - 1, -g)
        found = sign.isNotNull() & (line >= 1) & (line * block < size - block)
        return F.when(found, F.struct(F.lit(name).alias("way"), line.alias("line"), along.alias("along"), sign.alias("gray")))

    pairs = pixels.select("image", F.explode(F.array_compact(F.array(beside(y, x, height, "h"), beside(x, y, width, "v")))).alias("p")).select("image", "p.*")
    steps = pairs.groupBy("image", "way", "line", "along").agg(F.abs(F.sum("gray")).alias("step"))
    lines = steps.groupBy("image", "way", "line").agg(F.avg("step").alias("step"))
    both = lines.groupBy("image").agg(
        *[f(F.when(F.col("way") == k, F.col("step"))).alias(f"{n}_{k}") for k in "hv" for n, f in (("m", F.avg), ("d", F.stddev_pop))],
    )

    def regular(k: str) -> Column:  # a deviation of rounding errors only is none
        return F.when(F.col(f"d_{k}") > 1e-9, F.col(f"m_{k}") / (F.col(f"d_{k}") + 1e-5)).otherwise(0.0)

    score = F.least(F.lit(1.0), (regular("h") + regular("v")) / 10)
    return both.select("image", F.col("m_h").alias("horizontal"), F.col("m_v").alias("vertical"), score.alias("score"), ((score > 0.3) & ((F.col("m_h") > 2) | (F.col("m_v") > 2))).alias("blocky"))


def vignette(pixels: DataFrame, width: int = 64, height: int = 64) -> DataFrame:
    """Dark corners: a square about the middle (a quarter of the shorter side to each hand) against the four corners (an eighth), by ratio and evenness."""
    x, y, g = F.col("x"), F.col("y"), F.col("gray")
    r, c = min(width, height) // 4, min(width, height) // 8
    centre = x.between(width // 2 - r, width // 2 + r) & y.between(height // 2 - r, height // 2 + r)
    corners = {f"{a}{b}": v & h for a, v in (("t", y <= c), ("b", y >= height - c)) for b, h in (("l", x <= c), ("r", x >= width - c))}
    one = pixels.groupBy("image").agg(F.avg(F.when(centre, g)).alias("centre"), *[F.avg(F.when(inside, g)).alias(k) for k, inside in corners.items()])
    four = [F.col(k) for k in corners]
    ratio = F.col("centre") / (mean_of(four) + 1e-5)
    consistent = F.lit(1.0) - F.sqrt(spread_of(four)) / (mean_of(four) + 1e-5)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio - 1) * consistent)
    return one.select("image", ratio.alias("ratio"), score.alias("score"), ((score > 0.3) & (ratio > 1.2)).alias("vignetted"))


def edge_strips(pixels: DataFrame, width: int = 64, height: int = 64) -> DataFrame:
    """The plain fallback: a border if the mean variance of the four edge strips is below 200."""
    w = max(1, min(20, min(width, height) // 20))
    x, y, g = F.col("x"), F.col("y"), F.col("gray")
    sides = [y < w, y >= height - w, x < w, x >= width - w]
    one = pixels.groupBy("image").agg(*[F.var_pop(F.when(c, g)).alias(f"v{i}") for i, c in enumerate(sides)])
    mean = (F.col("v0") + F.col("v1") + F.col("v2") + F.col("v3")) / 4
    return one.select("image", mean.alias("variance"), (mean < 200).alias("bordered"))


def stroke(width: int, height: int, w: int) -> Column:
    """The inside half of a line of ``w`` pixels drawn along the picture's edge."""
    x, y = F.col("x"), F.col("y")
    return (x <= w // 2) | (y <= w // 2) | (x >= width - w // 2) | (y >= height - w // 2)


def outline(width: int, height: int, w: int) -> Column:
    """The line of three pixels just inside a border of ``w`` pixels."""
    x, y = F.col("x"), F.col("y")
    box = x.between(w - 2, width - w + 2) & y.between(w - 2, height - w + 2)
    return box & ~(x.between(w + 1, width - w - 1) & y.between(w + 1, height - w - 1))


def enclosed(width: int, height: int, w: int) -> Column:
    return F.col("x").between(w, width - w) & F.col("y").between(w, height - w)


def border_statistics(pixels: DataFrame, border: int = 5, width: int = 64, height: int = 64) -> DataFrame:
    """Evenness of a border of the given width, agreement of its four sides, and of its four corners."""
    one = pixels.groupBy("image").agg(F.stddev_pop("gray").alias("all_dev"), *_border_aggs(border, width, height))
    return one.select("image", *[c.alias(n) for n, c in _border_scores(border).items()])


def _border_aggs(w: int, width: int, height: int) -> list[Column]:
    x, y, g = F.col("x"), F.col("y"), F.col("gray")
    c = min(2 * w, 15)
    corners = [a & b for a in (y < c, y >= height - c) for b in (x < c, x >= width - c)]
    rim = F.when(stroke(width, height, w), g)
    return [
        F.avg(rim).alias(f"rim_{w}"), F.stddev_pop(rim).alias(f"dev_{w}"), F.avg(F.when(enclosed(width, height, w), g)).alias(f"in_{w}"),
        *[F.avg(F.when(inside, g)).alias(f"{s}_{w}") for s, inside in strips(width, height, w).items()], *[F.avg(F.when(inside, g)).alias(f"k{i}_{w}") for i, inside in enumerate(corners)],
    ]


def _border_scores(w: int) -> dict[str, Column]:
    uniform = F.lit(1.0) - F.least(F.lit(1.0), F.col(f"dev_{w}") / F.greatest(F.lit(5.0), F.col("all_dev")) / 2)
    side = F.lit(1.0) - F.least(F.lit(1.0), spread_of([F.col(f"{s}_{w}") for s in SIDES]) / 400)
    corner = F.lit(0.8) if w < 4 else F.lit(1.0) - F.least(F.lit(1.0), spread_of([F.col(f"k{i}_{w}") for i in range(4)]) / 200)
    return {"uniformity": uniform, "side_consistency": side, "corner_consistency": corner}


def gradients(pixels: DataFrame) -> DataFrame:
    """``pixels`` with ``magnitude``, the length of the 3 by 3 Sobel gradient; edges are mirrored without the edge pixel."""
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")

    def beside(c: str, order) -> tuple[Column, Column]:
        before, after = F.lag(c).over(order), F.lead(c).over(order)
        return F.coalesce(before, after, F.col(c)), F.coalesce(after, before, F.col(c))

    left, right = beside("gray", row)
    flat = pixels.select("image", "x", "y", "gray", (right - left).alias("slope"), (left + 2 * F.col("gray") + right).alias("level"))
    (up, down), (above, below) = beside("slope", column), beside("level", column)
    return flat.select("image", "x", "y", "gray", F.hypot((up + 2 * F.col("slope") + down).cast("double"), (below - above).cast("double")).alias("magnitude"))


#: Shares of the shorter side that the border search tries, and weights of the parts of its score. Fixed values.
WIDTH_SHARES = [0.008, 0.015, 0.025, 0.040, 0.060]
#: The same for the region of a border, and for frames by colour. Fixed values.
REGION_SHARES = [0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1]
FRAME_SHARES = [0.01, 0.02, 0.03, 0.05]
WEIGHTS = {"contrast": 0.40, "uniformity": 0.30, "side_consistency": 0.15, "transition": 0.10, "corner_consistency": 0.05}


def simple_border(pixels: DataFrame, width: int = 64, height: int = 64, contrast: float = 30.0, widest: float = 0.15, least: float = 0.35) -> DataFrame:
    """Width search for an even border: (image, border_width, difference, score, detected).

    A candidate is taken into account if it differs from what it encloses by half of ``contrast``, is even and has
    consistent sides. Wide borders and pictures of low contrast score less. A vignette takes a narrow win away.
    """
    shorter = min(width, height)
    widths = sorted({max(2, int(shorter * s)) for s in WIDTH_SHARES if s <= widest})
    m = F.col("magnitude")
    one = gradients(pixels).groupBy("image").agg(
        F.stddev_pop("gray").alias("all_dev"), *[a for w in widths for a in _border_aggs(w, width, height)], *[F.avg(F.when(outline(width, height, w), m)).alias(f"edge_{w}") for w in widths if w > 2]
    )
    low = F.col("all_dev") < 30
    scored = [F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("w"), F.lit(0.0).alias("difference"))]
    for w in widths:
        parts = _border_scores(w)
        away = F.abs(F.col(f"rim_{w}") - F.col(f"in_{w}"))
        fit = (away >= contrast / 2) & (parts["uniformity"] >= 0.75) & (parts["side_consistency"] >= 0.70)
        parts |= {"contrast": F.least(F.lit(1.0), away / contrast), "uniformity": F.greatest(F.lit(0.0), (parts["uniformity"] - 0.5) * 2), "transition": F.least(F.lit(1.0), F.col(f"edge_{w}") / 30) if w > 2 else F.lit(0.5)}
        ratio = w / shorter
        factor = max(0.7, 1 - (ratio - widest / 2) * 3) if ratio > widest / 2 else 1.0
        score = sum((parts[k] * v for k, v in WEIGHTS.items()), F.lit(0.0)) * factor * F.when(low, 0.9).otherwise(1.0)
        scored.append(F.when(fit, F.struct(score.alias("score"), F.lit(-w).alias("w"), away.alias("difference"))).otherwise(scored[0]))
    found = one.select("image", F.when(low, least * 1.2).otherwise(least).alias("bar"), F.array_max(F.array(*scored)).alias("b"))
    joined = found.join(vignette(pixels, width, height).select("image", F.col("vignetted"), F.col("score").alias("shade")), "image")
    over = F.col("b.score") > F.col("bar")
    veto = over & F.col("vignetted") & (F.col("shade") > 0.6) & (F.col("b.score") < F.col("bar") * 1.5)
    return joined.select("image", (-F.col("b.w")).alias("border_width"), F.col("b.difference").alias("difference"), (F.col("b.score") * F.when(veto, 0.8).otherwise(1.0)).alias("score"), (over & ~veto).alias("detected"))


def border_region(pixels: DataFrame, width: int = 64, height: int = 64, contrast: float = 30.0) -> DataFrame:
    """(image, border_width, regions): where a border lies, as boxes (side, x0, y0, x1, y1) of the width that separates best; none: 0 and no boxes."""
    g, shorter = F.col("gray"), min(width, height)
    widths = sorted({w for s in REGION_SHARES if (w := int(shorter * s)) >= 2})
    aggs = [a for w in widths for a in (F.avg(F.when(stroke(width, height, w), g)).alias(f"m{w}"), F.stddev_pop(F.when(stroke(width, height, w), g)).alias(f"d{w}"), F.avg(F.when(enclosed(width, height, w), g)).alias(f"i{w}"))]
    one = pixels.groupBy("image").agg(*aggs or [F.count("*").alias("n")])
    scored = [F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("w"))]
    for w in widths:
        away = F.abs(F.col(f"m{w}") - F.col(f"i{w}"))
        score = away * (F.lit(1.0) - F.least(F.lit(1.0), F.col(f"d{w}") / 30))
        scored.append(F.when((away > contrast / 2) & (score > 0), F.struct(score.alias("score"), F.lit(-w).alias("w"))).otherwise(scored[0]))
    b = F.col("border_width")

    def box(side: str, x0, y0, x1, y1) -> Column:
        return F.struct(F.lit(side).alias("side"), *[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])

    boxes = F.array(box("top", 0, 0, width, b), box("bottom", 0, height - b, width, height), box("left", 0, 0, b, height), box("right", width - b, 0, width, height))
    return one.select("image", (-F.array_max(F.array(*scored))["w"]).alias("border_width")).withColumn("regions", F.when(b > 0, boxes).otherwise(F.filter(boxes, lambda r: F.lit(False))))


def side_measures(pixels: DataFrame, border: int = 5, width: int = 64, height: int = 64) -> DataFrame:
    """Evenness of each side by itself (the least, and how alike they are), symmetry of opposite sides, and sharpness of the step inside."""
    g = F.col("gray")
    sides = strips(width, height, border)
    one = gradients(pixels).groupBy("image").agg(
        *[F.avg(F.when(v, g)).alias(f"m_{s}") for s, v in sides.items()], *[F.stddev_pop(F.when(v, g)).alias(f"d_{s}") for s, v in sides.items()], F.avg(F.when(outline(width, height, border), F.col("magnitude"))).alias("edge")
    )
    even = [F.lit(1.0) - F.least(F.lit(1.0), F.col(f"d_{s}") / 30) for s in SIDES]
    alike = F.when(mean_of(even) > 0, F.lit(1.0) - F.sqrt(spread_of(even)) / mean_of(even)).otherwise(1.0)
    level = [F.lit(1.0) - F.least(F.lit(1.0), F.abs(F.col(f"m_{a}") - F.col(f"m_{b}")) / 50) for a, b in (("top", "bottom"), ("left", "right"))]
    return one.select("image", F.least(*even).alias("least_uniformity"), alike.alias("side_consistency"), mean_of(level).alias("symmetry"), F.least(F.lit(1.0), F.col("edge") / 50).alias("sharpness"))


def border_symmetry(pixels: DataFrame, width: int = 64, height: int = 64, share: float = 0.15, bins: int = 64) -> DataFrame:
    """Whether opposite sides have alike histograms: the mean of their two correlations, above 0.7.

    Two histograms of one bin each that is the same correlate fully. A pixel in two strips counts in both.
    """
    inside = strips(width, height, int(min(width, height) * share))
    hist = pixels.groupBy("image", F.floor(F.col("gray") / (256 // bins)).alias("bin")).agg(*[F.count_if(v).cast("double").alias(s) for s, v in inside.items()])
    pairs = (("top", "bottom"), ("left", "right"))
    sums = [F.sum(s).alias(s) for s in SIDES] + [F.sum(F.col(s) * F.col(s)).alias(f"{s}2") for s in SIDES] + [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]
    one = hist.groupBy("image").agg(*sums)

    def correlation(a: str, b: str) -> Column:
        top = F.col(f"{a}_{b}") - F.col(a) * F.col(b) / bins
        below = (F.col(f"{a}2") - F.col(a) * F.col(a) / bins) * (F.col(f"{b}2") - F.col(b) * F.col(b) / bins)
        return F.when(below > 1e-9, top / F.sqrt(below)).otherwise(1.0)

    score = mean_of([correlation(a, b) for a, b in pairs])
    return one.select("image", score.alias("score"), (score > 0.7).alias("symmetric"))


def gradient_ratio(pixels: DataFrame, width: int = 64, height: int = 64, share: float = 0.15) -> DataFrame:
    """Gradient at the perimeter over that in the middle; above 1.5 there is a frame."""
    w = int(min(width, height) * share)
    middle = F.col("x").between(w, width - w) & F.col("y").between(w, height - w)
    one = gradients(pixels).groupBy("image").agg(F.avg(F.when(~middle, F.col("magnitude"))).alias("rim"), F.avg(F.when(middle, F.col("magnitude"))).alias("mid"))
    ratio = F.col("rim") / (F.coalesce("mid", F.lit(0.0)) + 1e-10)
    return one.select("image", ratio.alias("ratio"), (ratio > 1.5).alias("framed"))


def colour_consistency(colours: DataFrame, border: int = 5, width: int = 64, height: int = 64) -> DataFrame:
    """How alike the step from a border to what it encloses is in the three channels of (image, x, y, r, g, b)."""
    aggs = [F.avg(F.when(where, F.col(c))).alias(f"{c}_{n}") for c in "rgb" for n, where in (("out", stroke(width, height, border)), ("in", enclosed(width, height, border)))]
    steps = [F.abs(F.col(f"{c}_out") - F.col(f"{c}_in")) for c in "rgb"]
    mean = mean_of(steps)
    score = F.when(mean > 0, F.lit(1.0) - F.least(F.lit(1.0), spread_of(steps) / (mean * mean))).otherwise(0.0)
    return colours.groupBy("image").agg(*aggs).select("image", score.alias("colour_consistency"))


def fallback_editing(colours: DataFrame) -> DataFrame:
    """Editing score without models, from the histograms of the three channels: (image, entropy, n_peaks, score, passed)."""
    channel = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in "rgb"]))
    hist = colours.select("image", channel.alias("c")).groupBy("image", "c.channel", "c.value").agg(F.count("*").alias("n"))
    packed = hist.groupBy("image", "channel").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("h"), F.sum("n").alias("total"))
    full = packed.select("image", "total", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.try_element_at("h", b), F.lit(0))).alias("h"))
    entropy = -F.aggregate("h", F.lit(0.0), lambda s, n: s + n / F.col("total") * F.log2(n / F.col("total") + 1e-10))
    peaks = F.size(F.filter(F.sequence(F.lit(1), F.lit(254)), lambda i: (F.get("h", i) > F.get("h", i - 1)) & (F.get("h", i) > F.get("h", i + 1))))
    one = full.select("image", entropy.alias("entropy"), peaks.alias("peaks")).groupBy("image").agg(F.avg("entropy").alias("entropy"), F.sum("peaks").alias("n_peaks"))
    score = fallback_editing_score(F.col("entropy"), F.col("n_peaks"))
    return one.select("image", "entropy", "n_peaks", score.cast("double").alias("score"), (score < 20).alias("passed"))


def hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue (0..179), saturation and value (0..255) of a colour, rounded to whole numbers."""
    top, span = F.greatest(r, g, b), (F.greatest(r, g, b) - F.least(r, g, b)).cast("double")
    turn = F.when(span == 0, 0.0).when(top == r, (g - b) * 60.0 / span).when(top == g, (b - r) * 60.0 / span + 120).otherwise((r - g) * 60.0 / span + 240)
    hue = F.round(F.when(turn < 0, turn + 360).otherwise(turn) / 2)
    return {"h": F.when(hue == 180, 0.0).otherwise(hue), "s": F.when(top == 0, 0.0).otherwise(F.round(span * 255 / top)), "v": top.cast("double")}


#: Rows of the matrix from linear RGB to XYZ, over the white point. Fixed values.
XYZ = {"X": (0.412453, 0.357580, 0.180423, 0.950456), "Y": (0.212671, 0.715160, 0.072169, 1.0), "Z": (0.019334, 0.119193, 0.950227, 1.088754)}


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Lightness and the two colour axes, each scaled to 0..255 and rounded."""

    def linear(c: Column) -> Column:
        u = c / F.lit(255.0)
        return F.when(u > 0.04045, F.pow((u + 0.055) / 1.055, F.lit(2.4))).otherwise(u / 12.92)

    xyz = {k: (linear(r) * p + linear(g) * q + linear(b) * s) / white for k, (p, q, s, white) in XYZ.items()}
    f = {k: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116) for k, t in xyz.items()}
    light = F.when(xyz["Y"] > 0.008856, f["Y"] * 116 - 16).otherwise(xyz["Y"] * 903.3)
    return {"l": F.round(light * 255 / 100), "a": F.round((f["X"] - f["Y"]) * 500 + 128), "b_": F.round((f["Y"] - f["Z"]) * 200 + 128)}


def colour_frame(colours: DataFrame, width: int = 64, height: int = 64, contrast: float = 30.0) -> DataFrame:
    """(image, difference, confidence, detected): a frame by the strongest step in gray, hue, saturation, value or lightness.

    For each candidate width the outer line is compared with the line inside it (gray) and with the middle; hue counts
    round the circle. A step above 1, in units of each channel, is a frame.
    """
    x, y = F.col("x"), F.col("y")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    gray = F.round(r * 0.299 + g * 0.587 + b * 0.114)
    parts = {"gray": gray, **hsv(r, g, b), **lab(r, g, b)}
    flat = colours.select("image", "x", "y", *[c.alias(n) for n, c in parts.items()])
    widths = sorted({w for s in FRAME_SHARES if (w := int(min(width, height) * s)) >= 1})
    aggs = []
    for w in widths:
        inset = max(1, w // 2)
        near = inset // 2
        box = x.between(w - near, width - w + near) & y.between(w - near, height - w + near)
        line = box & ~(x.between(w + near + 1, width - w - near - 1) & y.between(w + near + 1, height - w - near - 1))
        rim, middle = stroke(width, height, w), enclosed(width, height, w + inset)
        aggs += [F.avg(F.when(line, F.col("gray"))).alias(f"line_{w}"), F.stddev_pop(F.when(rim, F.col("gray"))).alias(f"dev_{w}")]
        aggs += [F.avg(F.when(where, F.col(n))).alias(f"{n}_{k}_{w}") for n in parts for k, where in (("out", rim), ("in", middle))]
    one = flat.groupBy("image").agg(*aggs or [F.count("*").alias("n")])
    scored = [F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("w"), F.lit(0.0).alias("difference"))]
    for w in widths:
        step = {n: F.abs(F.col(f"{n}_out_{w}") - F.col(f"{n}_in_{w}")) for n in parts}
        away = F.greatest(F.abs(F.col(f"gray_out_{w}") - F.col(f"line_{w}")), step["gray"])
        even = F.lit(1.0) - F.least(F.lit(1.0), F.col(f"dev_{w}") / 40)
        others = [F.least(step["h"], F.lit(180.0) - step["h"]) / 90, step["s"] / 128, step["v"] / 128, step["l"] / 100, step["a"] / 127, step["b_"] / 127]
        score = F.greatest(away / contrast * (even * 0.5 + 1), *[F.least(F.lit(1.5), o) for o in others])
        scored.append(F.when(score > 0, F.struct(score.alias("score"), F.lit(-w).alias("w"), away.alias("difference"))).otherwise(scored[0]))
    best = F.array_max(F.array(*scored))
    return one.select("image", best.alias("q")).select("image", F.col("q.difference").alias("difference"), F.least(F.lit(1.0), F.col("q.score") / 2).alias("confidence"), (F.col("q.score") > 1).alias("detected"))
