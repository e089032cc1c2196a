"""Editing and border scores as column expressions: normalised model scores, feature scores, weighted totals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tiers import finite, unit_score


def _line(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """The straight line through two points."""
    return F.lit(y0) + (x - x0) / (x1 - x0) * (y1 - y0)


def _knots(x: Column, knots: list[float], tail: float) -> Column:
    """0 up to the first knot, then lines to 50 and 85, then on to 95 at most, ten points for each ``tail``."""
    a, b, c = knots
    x = finite(x)
    return F.when(x.isNull(), None).when(x <= a, F.lit(0.0)).when(x <= b, _line(x, a, b, 0.0, 50.0)).when(x <= c, _line(x, b, c, 50.0, 85.0)).otherwise(F.least(F.lit(95.0), F.lit(85.0) + (x - c) / tail * 10.0))


def brisque_norm(x: Column) -> Column:
    return _knots(x, [31.4, 58.2, 80.5], 20.0)


def niqe_norm(x: Column) -> Column:
    return _knots(x, [4.2, 7.8, 12.5], 8.0)


def clipiqa_norm(x: Column) -> Column:
    """Null beyond 0.1..0.9; high scores mean little editing."""
    x = unit_score(x)
    return F.when(x.isNull() | (x < 0.1) | (x > 0.9), None).when(x >= 0.75, F.lit(0.0)).when(x >= 0.55, (F.lit(0.75) - x) / 0.20 * 40.0).otherwise(F.lit(40.0) + (F.lit(0.55) - x) / 0.45 * 50.0)


def model_count(*scores: Column) -> Column:
    total = F.lit(0)
    for s in scores:
        total = total + F.when(s.isNotNull(), 1).otherwise(0)
    return total


def model_average(*scores: Column) -> Column:
    """The mean of the scores there are; 0 without any."""
    total = F.lit(0.0)
    for s in scores:
        total = total + F.coalesce(s, F.lit(0.0))
    return total / F.greatest(model_count(*scores), F.lit(1))


def histogram_score(clipping: Column, entropy: Column, ks: Column) -> Column:
    """Mean of clipping, entropy and uniformity penalties, 100 at most."""
    clip = (
        F.when(clipping > 5, F.least(F.lit(90.0), F.lit(60.0) + (clipping - 5) / 10 * 30))
        .when(clipping > 1, F.lit(30.0) + (clipping - 1) / 4 * 30)
        .when(clipping > 0.1, clipping * 30)
        .otherwise(F.lit(0.0))
    )
    ent = F.when(entropy < 6.5, (F.lit(6.5) - entropy) / 6.5 * 70).when(entropy > 7.7, (entropy - 7.7) / 0.5 * 40).otherwise(F.lit(0.0))
    uni = F.when(ks > 0.15, F.least(F.lit(60.0), (ks - 0.15) / 0.35 * 60)).otherwise(F.lit(0.0))
    return F.least(F.lit(100.0), (clip + ent + uni) / 3)


def edge_score(laplacian: Column, density: Column, high: Column) -> Column:
    """Mean of sharpness, edge density and high-frequency penalties, 100 at most."""
    lap = (
        F.when(laplacian > 10000, F.least(F.lit(85.0), F.lit(60.0) + (laplacian - 10000) / 20000 * 25))
        .when(laplacian > 2000, (laplacian - 2000) / 8000 * 60)
        .when(laplacian < 100, (F.lit(100.0) - laplacian) / 100 * 50)
        .otherwise(F.lit(0.0))
    )
    den = F.when(density > 0.15, F.least(F.lit(70.0), (density - 0.15) / 0.25 * 70)).when(density < 0.05, (F.lit(0.05) - density) / 0.05 * 40).otherwise(F.lit(0.0))
    hig = F.when(high > 5000, F.least(F.lit(75.0), (high - 5000) / 15000 * 75)).when(high < 500, (F.lit(500.0) - high) / 500 * 30).otherwise(F.lit(0.0))
    return F.least(F.lit(100.0), (lap + den + hig) / 3)


def frequency_score(ratio: Column, variance: Column) -> Column:
    """Half the sum of the share's and the variance's penalties, 100 at most."""
    share = F.when((ratio > 0.15) | (ratio < 0.03), F.least(F.lit(60.0), F.abs(ratio - 0.09) / 0.1 * 60)).otherwise(F.lit(0.0))
    var = F.when(variance > 2, F.least(F.lit(40.0), (variance - 2) / 8 * 40)).when(variance < 0.5, (F.lit(0.5) - variance) / 0.5 * 25).otherwise(F.lit(0.0))
    return F.least(F.lit(100.0), (share + var) / 2)


def overall_score(n: Column, quality: Column, hist: Column, edge: Column, freq: Column) -> Column:
    """The weighted editing score 0..100; the weights depend on how many models answered and whether they agree."""
    features = (hist + edge + freq) / 3

    def mix(q: float, h: float, e: float, f: float) -> Column:
        return quality * q + hist * h + edge * e + freq * f

    many = F.when((quality < 30) & (features > 25), F.least(F.lit(100.0), mix(0.3, 0.3, 0.3, 0.1) * 1.4)).when(F.abs(quality - features) > 30, mix(0.6, 0.15, 0.15, 0.1)).otherwise(mix(0.7, 0.12, 0.12, 0.06))
    total = F.when(n >= 2, many).when(n == 1, mix(0.4, 0.25, 0.25, 0.1)).otherwise(mix(0.0, 0.4, 0.4, 0.2))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


#: By points, from none to five. Fixed values.
CONFIDENCE = ["Very Low", "Low", "Medium", "High", "Very High", "Extremely High"]


def confidence_label(n: Column, hist: Column, edge: Column, freq: Column, overall: Column) -> Column:
    """How far to trust the score: points for models, for features that agree and for a clear result."""
    mean = (hist + edge + freq) / 3
    spread = F.sqrt(((hist - mean) * (hist - mean) + (edge - mean) * (edge - mean) + (freq - mean) * (freq - mean)) / 3)
    points = F.when(n >= 2, 3).when(n == 1, 1).otherwise(0) + F.when(spread < 10, 2).when(spread < 20, 1).otherwise(0) + F.when((overall > 70) | (overall < 30), 1).otherwise(0)
    return F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.least(points, F.lit(5)) + 1)


#: Weight of a detection method's evidence; other methods have OTHER_METHOD. Fixed values.
METHOD_WEIGHT = {"obvious": 1.0, "simple": 0.8, "frame": 0.7, "texture": 0.6}
OTHER_METHOD = 0.5


def strongest_evidence(scores: Column) -> Column:
    """Of array<struct<method, score>>, the largest weighted score; 0 for none."""

    def weighted(s: Column) -> Column:
        w = F.lit(OTHER_METHOD)
        for method, value in METHOD_WEIGHT.items():
            w = F.when(s["method"] == method, value).otherwise(w)
        return s["score"] * w

    return F.coalesce(F.array_max(F.transform(scores, weighted)), F.lit(0.0))


def calibrated(x: Column) -> Column:
    """Weak evidence is weakened, very strong evidence dampened; kept in 0..1."""
    y = F.when(x < 0.2, x * 0.8).when(x > 0.8, F.lit(0.8) + (x - 0.8) * 0.5).otherwise(x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))


def robust_confidence(scores: Column, noise: Column, uniform: Column, artifacts: Column, vignette: Column) -> Column:
    """Border confidence: the strongest evidence, adjusted for noise, uniform surrounds, block artefacts and vignetting."""
    base = strongest_evidence(scores)
    by_noise = F.when(noise > 25, F.greatest(F.lit(0.7), F.lit(1.0) - (noise - 25) / 50)).otherwise(F.lit(1.0))
    by_uniform = F.when(uniform & (base > 0.58), 1.1).when(uniform, 0.8).otherwise(1.0)
    by_block = F.when(artifacts, 0.85).otherwise(1.0)
    by_vignette = F.when((vignette > 0.5) & (base < 0.58), 0.9).otherwise(1.0)
    return calibrated(base * by_noise * by_uniform * by_block * by_vignette)


def fallback_editing_score(entropy: Column, peaks: Column) -> Column:
    """Without models: points for little entropy and many histogram peaks."""
    return F.when(entropy < 5, 15).otherwise(0) + F.when(peaks > 30, 10).otherwise(0) + F.when(entropy < 4, 20).otherwise(0)
