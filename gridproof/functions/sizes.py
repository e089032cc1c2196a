"""Sizes that pictures are brought to before a detector sees them, as column arithmetic; fractions of pixels are cut off.

A side may come out with no pixels (1 by 4200 within 2000), and then nothing can be scaled by it: such a size is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))


def scaled(width: Column, height: Column, factor: Column) -> Column:
    return size(F.floor(width * factor), F.floor(height * factor))


def longest_within(width: Column, height: Column, most: int, least: int | None = None) -> Column:
    """Scaled so that the longer side is ``most`` where it is longer and, if asked, ``least`` where it is shorter."""
    longer = F.greatest(width, height)
    out = F.when(longer > most, scaled(width, height, F.try_divide(F.lit(float(most)), longer)))
    if least is not None:
        out = out.when(longer < least, scaled(width, height, F.try_divide(F.lit(float(least)), longer)))
    return out.otherwise(size(width, height))


def for_text(width: Column, height: Column) -> Column:
    return longest_within(width, height, 2000, 800)


def for_borders(width: Column, height: Column) -> Column:
    return longest_within(width, height, 1500)


def for_hard_pictures(width: Column, height: Column) -> Column:
    """The longer side 2000 at most, then the shorter one 32 at least."""
    one = longest_within(width, height, 2000)
    return shortest_from(one["width"], one["height"], 32)


def shortest_from(width: Column, height: Column, least: int) -> Column:
    """Scaled so that the shorter side is ``least`` where it is shorter."""
    shorter = F.least(width, height)
    return F.when(shorter < least, scaled(width, height, F.try_divide(F.lit(float(least)), shorter))).otherwise(size(width, height))


def for_clip(width: Column, height: Column) -> Column:
    """Sides of 224 at least; if one was over 2048, the longer one 2048 and the other by the original proportions."""
    ratio = F.try_divide(width, height)
    large = F.when(ratio > 1, size(F.lit(2048), F.floor(F.try_divide(F.lit(2048.0), ratio)))).otherwise(size(F.floor(F.lit(2048.0) * ratio), F.lit(2048)))
    return F.when((width > 2048) | (height > 2048), large).otherwise(size(F.greatest(width, F.lit(224)), F.greatest(height, F.lit(224))))


def text_input(width: Column, height: Column, channels: Column, least: int = 20, most: int = 3000) -> Column:
    """struct<fix, width, height, crop_x, crop_y, ok> of what a text recogniser is given.

    ``fix``: how channels become three (null: can't). A side over twenty times the other is cropped about its middle;
    then the larger of the factors that bring the sides into ``least`` and ``most`` is applied; ``ok`` says whether both are met.
    """
    fix = F.when(channels == 3, "none").when(channels == 1, "gray to colour").when(channels == 4, "drop alpha")
    down = F.when(F.greatest(width, height) > most, F.try_divide(F.lit(float(most)), F.greatest(width, height))).otherwise(1.0)
    up = F.when(F.least(width, height) < least, F.try_divide(F.lit(float(least)), F.least(width, height))).otherwise(0.0)
    factor = F.greatest(down, up)
    w, h = F.when(width > height * 20, height * 20).otherwise(width), F.when(height > width * 20, width * 20).otherwise(height)
    fw, fh = F.floor(w * factor).cast("int"), F.floor(h * factor).cast("int")
    return F.struct(
        fix.alias("fix"), fw.alias("width"), fh.alias("height"), F.floor((width - w) / 2).cast("int").alias("crop_x"), F.floor((height - h) / 2).cast("int").alias("crop_y"),
        (fix.isNotNull() & (F.least(fw, fh) >= least) & (F.greatest(fw, fh) <= most)).alias("ok"),
    )
