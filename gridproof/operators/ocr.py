"""Text found in images: filters, confidence, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiers


#: What counts as white space around a text: every Unicode space and the separators U+001C to U+001F. Fixed values.
SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def is_noise(text: Column) -> Column:
    """Text that is no text: up to three equal characters, four or more with few distinct ones, or marks only."""
    t = F.lower(stripped(text))
    n = F.length(t)
    distinct = F.size(F.array_distinct(F.filter(F.split(t, ""), lambda c: c != "")))
    few = (n <= 3) & (distinct == 1)
    dull = (n >= 4) & (distinct / F.greatest(n, F.lit(1)) < 0.3)
    return few | dull | t.rlike(r"^[^\p{L}\p{N}_\s]{2,}$")


def keep_text(text: Column, confidence: Column, w: Column, h: Column, least: float = 0.6, area: int = 50) -> Column:
    """Whether a finding is used: sure enough, 1 to 500 characters, large enough, something printable, no noise."""
    return (confidence >= least) & F.length(text).between(1, 500) & (w * h >= area) & text.rlike(r"\S") & ~is_noise(text)


def confidence_metrics(found: DataFrame, kept: Column | None = None, key: str = "image", *more: Column) -> DataFrame:
    """For each image, over the findings that are ``kept`` (default: all): count, means in percent, counts by level,
    text length, and the mean confidence weighted by length and confidence, in percent. An image without any has zeros.
    ``more`` are other aggregates of the same grouping.
    """
    use = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    c, n = F.when(use, F.col("confidence")), F.when(use, F.length("text"))
    weighted = F.try_divide(F.sum(n * c * c), F.nullif(F.sum(n * c), F.lit(0.0))) * 100

    def percent(x: Column) -> Column:
        return F.coalesce(F.avg(x) * 100, F.lit(0.0))

    return found.groupBy(key).agg(
        F.count_if(use).alias("n_texts"),
        percent(c).alias("average_confidence"),
        percent(F.when(use, F.col("detection"))).alias("detection_confidence"),
        percent(F.when(use, F.col("recognition"))).alias("recognition_confidence"),
        F.count_if(c >= 0.8).alias("n_high"),
        F.count_if((c >= 0.5) & (c < 0.8)).alias("n_medium"),
        F.count_if(c < 0.5).alias("n_low"),
        F.coalesce(F.sum(n), F.lit(0)).alias("text_length"),
        F.coalesce(weighted, F.lit(0.0)).alias("overall_confidence"),
        *more,
    )


def text_tiers(found: DataFrame, kept: Column | None = None, key: str = "image") -> DataFrame:
    m = confidence_metrics(found, kept, key)
    return m.select(key, "n_texts", "overall_confidence", tiers.text_tier(F.col("overall_confidence"), F.col("n_texts")).alias("status"), tiers.text_pass(F.col("overall_confidence"), F.col("n_texts")).alias("unified_pass"))


def batch_stats(metrics: DataFrame) -> DataFrame:
    """One row over all images: distribution of tiers, and mean, median, extremes and population deviation of confidence.

    The median is exact over hundredths of a percent, so that the map of values it is found in has 10,001 entries at most.
    """
    x = F.col("overall_confidence")
    return metrics.agg(
        F.count("*").alias("n_images"),
        F.count_if(F.col("status") == "fail").alias("n_fail"),
        F.count_if(F.col("status") == "manual").alias("n_manual"),
        F.count_if(F.col("status") == "pass").alias("n_pass"),
        F.avg(x).alias("mean"),
        F.median(F.round(x, 2)).alias("median"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.stddev_pop(x).alias("deviation"),
        F.sum("n_texts").alias("n_texts"),
    )


def zipped(texts: Column, scores: Column, boxes: Column) -> Column:
    """Parallel arrays as one array of struct, as long as the shortest."""
    n = F.least(F.size(texts), F.size(scores), F.size(boxes))
    return F.arrays_zip(F.slice(texts, 1, n).alias("text"), F.slice(scores, 1, n).alias("score"), F.slice(boxes, 1, n).alias("box"))


def bounding_box(polygon: Column) -> Column:
    """struct<x, y, w, h> of an array<struct<x, y>>; both ends count."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs) + 1).alias("w"), (F.array_max(ys) - F.array_min(ys) + 1).alias("h"))


def angle(polygon: Column) -> Column:
    """The first edge's direction in degrees."""
    a, b = F.get(polygon, 0), F.get(polygon, 1)
    return F.degrees(F.atan2((b["y"] - a["y"]).cast("double"), (b["x"] - a["x"]).cast("double")))
