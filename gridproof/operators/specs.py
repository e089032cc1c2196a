"""Format specifications as a small dimension table, and the rule that finds an asset's best one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JPEG = ["JPEG", "JPG", "jpeg", "jpg"]
PNG = ["PNG", "png"]
PRINT = [*JPEG, "TIFF", "tiff", "tif", "TIF", "PDF", "pdf"]

SCHEMA = (
    "spec_ord int, category string, spec string, width int, height int, min_width int, min_height int, dpi_x double, dpi_y double, "
    "dpi_lo double, dpi_hi double, formats array<string>, color_mode string, max_file_size_mb double"
)
#: The built-in catalogue, in order. Fixed values.
CATALOGUE = [
    (0, "website", "slider", 1920, 705, None, None, 72.0, 72.0, None, None, JPEG, None, None),
    (1, "website", "gallery", 800, 600, None, None, 72.0, 72.0, None, None, JPEG, None, None),
    (2, "publication", "digital_a4", 2480, 3508, 210, 297, None, None, 150.0, 200.0, [*JPEG, *PNG], "RGB", 1.0),
    (3, "publication", "digital_b5", 2079, 2953, 176, 250, None, None, 150.0, 200.0, [*JPEG, *PNG], "RGB", None),
    (4, "publication", "print_a4", 2480, 3508, 210, 297, 300.0, 300.0, None, None, PRINT, "CMYK", None),
    (5, "publication", "print_b5", 2079, 2953, 176, 250, 300.0, 300.0, None, None, PRINT, "CMYK", None),
]
DPI_TOLERANCE = 5.0


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, SCHEMA)


def spec_faults(specs: DataFrame) -> DataFrame:
    """The specifications that contradict themselves: smaller than their own minimum, or an empty DPI range."""
    return specs.where("width < min_width OR height < min_height OR dpi_lo > dpi_hi OR dpi_x <= 0 OR dpi_y <= 0")


def dpi_ok(a, s) -> Column:
    exact = (F.abs(a["dpi_x"] - s["dpi_x"]) <= DPI_TOLERANCE) & (F.abs(a["dpi_y"] - s["dpi_y"]) <= DPI_TOLERANCE)
    inside = a["dpi_x"].between(s["dpi_lo"], s["dpi_hi"]) & a["dpi_y"].between(s["dpi_lo"], s["dpi_hi"])
    return F.when(s["dpi_x"].isNotNull(), exact).when(s["dpi_lo"].isNotNull(), inside).otherwise(F.lit(True))


def size_ok(a, s) -> Column:
    exact = (a["width"] == s["width"]) & (a["height"] == s["height"])
    least = (a["width"] >= F.coalesce(s["min_width"], F.lit(0))) & (a["height"] >= F.coalesce(s["min_height"], F.lit(0)))
    return F.when(s["width"].isNotNull() & s["height"].isNotNull(), exact).otherwise(least)


def light_ok(a, s) -> Column:
    return s["max_file_size_mb"].isNull() | (a["file_size_mb"] <= s["max_file_size_mb"])


def mode_ok(mode: Column, wanted: Column) -> Column:
    return F.when(wanted == "CMYK", mode == "CMYK").when(wanted == "RGB", mode.isin("RGB", "RGBA")).otherwise(F.lit(True))


def matches(a, s) -> Column:
    """Whether an asset meets a specification: format, size in pixels (exact, else least), DPI, bytes and colour mode."""
    return F.array_contains(s["formats"], a["format"]) & size_ok(a, s) & dpi_ok(a, s) & light_ok(a, s) & mode_ok(a["mode"], s["color_mode"])


#: What a specification looks at.
PROPERTIES = ("width", "height", "format", "mode", "dpi_x", "dpi_y", "file_size_mb")
#: The same but for the bytes, and what a specification asks for but for formats and bytes.
LOOKS = PROPERTIES[:-1]
ASKED = ("width", "height", "min_width", "min_height", "dpi_x", "dpi_y", "dpi_lo", "dpi_hi", "color_mode")


def _text(v) -> Column:
    return F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v])


def best_spec(a: dict[str, Column], rows: list[tuple] | None = None, print_first: bool = True) -> Column:
    """The name of the best specification of an asset with the properties ``a``, or null; no shuffle.

    The catalogue is a handful of literals. The best match has the highest priority (100 for print, 10 for exact
    pixels), the first in catalogue order among equals. Null properties match nothing that asks for them.
    """
    names = [f.strip().split()[0] for f in SCHEMA.split(", ")]
    found = []
    for row in CATALOGUE if rows is None else rows:
        spec = dict(zip(names, row))
        s = {k: _text(v) for k, v in spec.items()}
        exact = spec["width"] is not None and spec["height"] is not None
        priority = (100 if print_first and "print" in spec["spec"] else 0) + (10 if exact else 0)
        found.append(F.when(F.coalesce(matches(a, s), F.lit(False)), F.struct(F.lit(priority).alias("p"), F.lit(-spec["spec_ord"]).alias("o"), F.lit(f"{spec['category']}_{spec['spec']}").alias("name"))))
    return F.array_max(F.array(*found))["name"] if found else F.lit(None).cast("string")


#: A catalogue of up to so many specifications becomes literals of the plan; a larger one is joined.
LITERALS = 64
#: Bins of a range grow by this factor, so that a range of any width is in a bounded number of bins.
STEP = 1.25
#: The least and the largest value that bins tell apart; what lies beyond shares the last bin on its side.
LOWEST, HIGHEST = 1e-3, 1e9


def bin_of(x: Column) -> Column:
    return F.floor(F.log(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), x.cast("double")))) / math.log(STEP)).cast("int")


def bins_between(low: Column, high: Column) -> Column:
    """All bins from that of ``low`` to that of ``high``; none where the range is empty."""
    return F.when(low <= high, F.sequence(bin_of(low), bin_of(high))).otherwise(F.array().cast("array<int>"))


def catalogue_match(assets: DataFrame, specs: DataFrame, key: str = "doc_id", print_first: bool = True) -> DataFrame:
    """As ``spec_match``, for a catalogue of any size: an interval join instead of literals or a nested loop.

    Format is an equal key; a specification of exact pixels has two more. One with a resolution, exact or a range, is
    filed under the bins of that range, any other under the bins of its least width, and an asset looks into the bin of
    its own. A null property matches nothing that asks for it.

    What grows with the tables is not joined. Assets ask by what they look like but for their bytes, once for all that
    are alike; of specifications that ask for the same, only the best for each limit of bytes is filed. The answer of
    such a look is a flight of steps, as many as there are different limits at most: its best specification, then the
    best of those that take more bytes, and so on.
    An asset's own specification is the first step that takes its bytes.
    """
    look = F.struct(*[F.col(c) for c in LOOKS])
    looks = assets.select(look.alias("a")).distinct().select("a", F.xxhash64("a").alias("look"))
    asked = looks.select("look", "a", F.array_compact(F.array(
        F.when(F.col("a.width").isNotNull() & F.col("a.height").isNotNull(), F.struct(F.lit("exact").alias("way"), F.col("a.width").cast("long").alias("x"), F.col("a.height").cast("long").alias("y"))),
        F.when(F.col("a.dpi_x").isNotNull(), F.struct(F.lit("dpi").alias("way"), bin_of(F.col("a.dpi_x")).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))),
        F.when(F.col("a.width").isNotNull(), F.struct(F.lit("width").alias("way"), bin_of(F.col("a.width")).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))),
    )).alias("keys")).select("look", "a", F.col("a.format").alias("format"), F.inline("keys"))

    exact = F.col("width").isNotNull() & F.col("height").isNotNull()
    low, high = F.coalesce(F.col("dpi_x") - DPI_TOLERANCE, "dpi_lo"), F.coalesce(F.col("dpi_x") + DPI_TOLERANCE, "dpi_hi")
    by_dpi, by_width = bins_between(low, high), bins_between(F.coalesce(F.col("min_width"), F.lit(0)).cast("double"), F.lit(HIGHEST))

    def place(way: str, x: Column, y: Column) -> Column:
        return F.named_struct(F.lit("way"), F.lit(way), F.lit("x"), x.cast("long"), F.lit("y"), y.cast("long"))

    def filed(way: str, bins: Column) -> Column:
        return F.transform(bins, lambda b: place(way, b, F.lit(0)))

    places = F.when(exact, F.array(place("exact", F.col("width"), F.col("height")))).when(low.isNotNull() & high.isNotNull(), filed("dpi", by_dpi)).otherwise(filed("width", by_width))
    # no limit of bytes comes after every other
    limit = F.struct(F.col("max_file_size_mb").isNull().alias("none"), F.col("max_file_size_mb").alias("mb"))
    priority = F.when(F.lit(print_first) & F.contains(F.col("spec"), F.lit("print")), 100).otherwise(0) + F.when(exact, 10).otherwise(0)
    rated = specs.select(*ASKED, limit.alias("limit"), F.explode(F.array_distinct("formats")).alias("format"), F.struct(priority.alias("p"), (-F.col("spec_ord")).alias("o"), F.concat_ws("_", "category", "spec").alias("spec")).alias("rank"))
    listed = rated.groupBy(*ASKED, "format", "limit").agg(F.max("rank").alias("rank")).select(F.struct(*ASKED).alias("s"), "format", "limit", "rank", places.alias("places")).select("s", "format", "limit", "rank", F.inline("places"))

    a, s = ({c: F.col(f"{side}.{c}") for c in of} for side, of in (("a", LOOKS), ("s", ASKED)))
    met = asked.join(listed, ["format", "way", "x", "y"]).where(size_ok(a, s) & dpi_ok(a, s) & mode_ok(a["mode"], s["color_mode"]))
    best = met.groupBy("look", "a", "limit").agg(F.max("rank").alias("rank"))
    before = Window.partitionBy("look", "a").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    useful = best.withColumn("most", F.max("limit").over(before)).where(F.col("most").isNull() | (F.col("limit") > F.col("most")))
    steps = useful.groupBy("look", "a").agg(F.array_sort(F.collect_list(F.struct("limit", "rank"))).alias("steps")).select("look", F.col("a").alias("own"), "steps")
    rows = assets.select(key, look.alias("a"), F.col("file_size_mb").alias("_mb")).withColumn("look", F.xxhash64("a"))
    # equal hashes are not taken for equal properties
    found = rows.join(steps, (rows["look"] == steps["look"]) & rows["a"].eqNullSafe(steps["own"]), "left")
    first = F.filter("steps", lambda t: t["limit"]["none"] | (F.col("_mb") <= t["limit"]["mb"]))
    return found.select(key, F.get(first, 0)["rank"]["spec"].alias("spec")).select(key, F.col("spec").isNotNull().alias("matched"), "spec")


def spec_match(assets: DataFrame, specs: DataFrame | None = None, key: str = "doc_id", print_first: bool = True) -> DataFrame:
    """(key, matched, spec): every asset with its best specification, or none.

    ``specs`` is a catalogue of SCHEMA (default: the built-in one). Up to LITERALS rows become literals of the plan, so
    that nothing is shuffled; a larger one is joined (``catalogue_match``).
    """
    rows = None
    if specs is not None:
        rows = [tuple(r) for r in specs.select(*[f.strip().split()[0] for f in SCHEMA.split(", ")]).limit(LITERALS + 1).collect()]
        if len(rows) > LITERALS:
            return catalogue_match(assets, specs, key, print_first)
    spec = best_spec({c: F.col(c) for c in PROPERTIES}, rows, print_first)
    return assets.select(key, spec.alias("spec")).select(key, F.col("spec").isNotNull().alias("matched"), "spec")


def spec_failures(a: dict[str, Column], rows: list[tuple] | None = None) -> Column:
    """array<struct<spec, reasons>>: for each specification what an asset lacks, in catalogue order; an empty array of reasons is a match."""
    names = [f.strip().split()[0] for f in SCHEMA.split(", ")]
    out = []
    for row in CATALOGUE if rows is None else rows:
        spec = dict(zip(names, row))
        s = {k: _text(v) for k, v in spec.items()}
        checks = {"format": F.array_contains(s["formats"], a["format"]), "dimensions": size_ok(a, s), "dpi": dpi_ok(a, s), "file_size": light_ok(a, s), "color_mode": mode_ok(a["mode"], s["color_mode"])}
        lacks = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in checks.items()]))
        out.append(F.struct(F.lit(f"{spec['category']}_{spec['spec']}").alias("spec"), lacks.alias("reasons")))
    return F.array(*out)


def fallback_spec(width: Column, height: Column) -> Column:
    """Without a catalogue: the shorter side has 800 pixels, the longer one 4000 at most."""
    return F.when(F.least(width, height) < 800, "too small").when(F.greatest(width, height) > 4000, "too large").otherwise("ok")


#: Extensions that validation takes. Fixed values.
SUPPORTED = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp"]


def validation(exists: Column, extension: Column, size: Column, width: Column, height: Column, supported: list[str] = SUPPORTED, min_bytes: int = 100, max_mb: int = 50, min_side: int = 100) -> Column:
    """The code of the first check that fails, in order, or ``ok``."""
    return (
        F.when(~exists, "file_not_found")
        .when(~F.lower(extension).isin(supported), "unsupported_format")
        .when(size < min_bytes, "file_too_small")
        .when(size > max_mb * 1024 * 1024, "file_too_large")
        .when((width == 0) | (height == 0), "invalid_dimensions")
        .when(width < min_side, "width_too_small")
        .when(height < min_side, "height_too_small")
        .otherwise("ok")
    )


def with_clash_names(files: DataFrame, category: str = "category", filename: str = "filename", path: str = "path") -> DataFrame:
    """``target``: the filename, with ``_1``, ``_2``, ... before the extension where the category has the name already.

    Rows are ranked within (category, filename), so one common name is the only thing that meets in a task.
    """
    n = F.row_number().over(Window.partitionBy(category, filename).orderBy(path)) - 1
    stem, ext = F.regexp_replace(filename, r"\.[^.]*$", ""), F.regexp_extract(filename, r"(\.[^.]*)$", 1)
    return files.withColumn("target", F.when(n == 0, F.col(filename)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))
