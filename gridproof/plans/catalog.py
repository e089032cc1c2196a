"""name -> query over a folder of tables, and name -> the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions import tiers
from ..operators import components, ocr, pictures, reports, resample, scans, specs, verdicts
from ..sources import copies
from ..sources.tables import read_table
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEY = ["doc_id", "filename"]
#: Rounding to six digits by arithmetic that gives the same double everywhere, also at an exact half.
_ROUND = "floor(({0}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


def _round(x: Column) -> Column:
    return F.floor(x * F.lit(1e6) + 0.5) / F.lit(1e6)


def query(sql: str | None = None):
    """Registers a query under its own name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- specifications and basic validation -------------------------------------------------------------------------


@query(f"""WITH {views.ASSETS_SQL} SELECT doc_id, {views._SPEC_OK} AS matched, CASE WHEN NOT {views._SPEC_OK} THEN NULL
 WHEN width = 1920 THEN 'website_slider' WHEN width = 800 THEN 'website_gallery' WHEN width = 2480 AND mode = 'CMYK' THEN 'publication_print_a4'
 WHEN width = 2480 THEN 'publication_digital_a4' WHEN mode = 'CMYK' THEN 'publication_print_b5' ELSE 'publication_digital_b5' END AS spec FROM assets""")
def spec_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.spec_match(views.assets(spark, sf_dir))


#: A large catalogue, a specification for each part: exact pixels, resolutions or least sizes, made from its key and size.
_CAT = [
    "CAST(p_partkey AS INT) AS spec_ord",
    "p_brand AS category",
    "concat(CASE WHEN p_partkey % 7 = 0 THEN 'print_' ELSE 'web_' END, CAST(p_partkey AS STRING)) AS spec",
    "CASE WHEN p_partkey % 5 < 2 THEN CAST(CASE p_partkey % 4 WHEN 0 THEN 1920 WHEN 1 THEN 800 WHEN 2 THEN 2480 ELSE 640 END + p_size % 3 AS INT) END AS width",
    "CASE WHEN p_partkey % 5 < 2 THEN CAST(CASE p_partkey % 4 WHEN 0 THEN 705 WHEN 1 THEN 600 WHEN 2 THEN 3508 ELSE 480 END AS INT) END AS height",
    "CASE WHEN p_partkey % 5 >= 2 THEN CAST(500 + p_size * 60 AS INT) END AS min_width",
    "CASE WHEN p_partkey % 5 = 3 THEN CAST(300 + p_size * 50 AS INT) END AS min_height",
    "CASE WHEN p_partkey % 10 = 0 THEN CAST(72 + p_partkey % 9 * 30 AS DOUBLE) END AS dpi_x",
    "CASE WHEN p_partkey % 10 = 0 THEN CAST(72 + p_partkey % 9 * 30 AS DOUBLE) END AS dpi_y",
    "CASE WHEN p_partkey % 5 IN (2, 3) OR p_size <= 45 THEN CAST(p_size * 6 AS DOUBLE) END AS dpi_lo",
    "CASE WHEN p_partkey % 5 IN (2, 3) OR p_size <= 45 THEN CAST(p_size * 6 + p_partkey % 40 AS DOUBLE) END AS dpi_hi",
    "CASE p_partkey % 3 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG,TIFF' ELSE 'PDF,BMP,JPEG' END AS listed",
    "CASE p_partkey % 6 WHEN 0 THEN 'CMYK' WHEN 1 THEN 'RGB' END AS color_mode",
    "CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) / 10 END AS max_file_size_mb",
]


@query(f"""WITH {views.ASSETS_SQL}, specs AS (SELECT *, string_split(listed, ',') AS formats FROM (SELECT {views.duck(_CAT)} FROM part)),
 met AS (SELECT doc_id, concat(category, '_', spec) AS spec, CASE WHEN spec LIKE '%print%' THEN 100 ELSE 0 END + CASE WHEN s.width IS NOT NULL AND s.height IS NOT NULL THEN 10 ELSE 0 END AS priority, spec_ord
  FROM assets a, specs s WHERE list_contains(s.formats, a.format) AND CASE WHEN s.width IS NOT NULL AND s.height IS NOT NULL THEN a.width = s.width AND a.height = s.height ELSE a.width >= coalesce(s.min_width, 0) AND a.height >= coalesce(s.min_height, 0) END
  AND CASE WHEN s.dpi_x IS NOT NULL THEN abs(a.dpi_x - s.dpi_x) <= 5 AND abs(a.dpi_y - s.dpi_y) <= 5 WHEN s.dpi_lo IS NOT NULL THEN a.dpi_x BETWEEN s.dpi_lo AND s.dpi_hi AND a.dpi_y BETWEEN s.dpi_lo AND s.dpi_hi ELSE TRUE END
  AND (s.max_file_size_mb IS NULL OR a.file_size_mb <= s.max_file_size_mb) AND CASE s.color_mode WHEN 'CMYK' THEN a.mode = 'CMYK' WHEN 'RGB' THEN a.mode IN ('RGB', 'RGBA') ELSE TRUE END),
 best AS (SELECT doc_id, arg_max(spec, (priority, -spec_ord)) AS spec FROM met GROUP BY doc_id)
 SELECT doc_id, best.spec IS NOT NULL AS matched, best.spec FROM documents LEFT JOIN best USING (doc_id)""")
def catalogue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset against a specification for each part, by an interval join."""
    made = read_table(spark, sf_dir, "part").selectExpr(*_CAT).withColumn("formats", F.split("listed", ","))
    return specs.spec_match(views.assets(spark, sf_dir), made)


#: Files for basic validation: missing ones, odd extensions, sizes at and around the limits. Several faults meet in one row.
_FILES = [
    "doc_id",
    "doc_id % 11 <> 0 AS found",
    "CASE doc_id % 7 WHEN 0 THEN '.JPG' WHEN 1 THEN '.webp' WHEN 2 THEN '.pdf' WHEN 3 THEN '' ELSE '.png' END AS extension",
    "CAST(CASE doc_id % 9 WHEN 0 THEN 99 WHEN 1 THEN 100 WHEN 2 THEN 52428800 WHEN 3 THEN 52428801 ELSE n_chars * 64 + 100 END AS BIGINT) AS file_size",
    "CAST(CASE doc_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 99 WHEN 2 THEN 100 ELSE 640 END AS INT) AS width",
    "CAST(CASE doc_id % 13 WHEN 0 THEN 0 WHEN 1 THEN 99 WHEN 2 THEN 100 ELSE 480 END AS INT) AS height",
]


@query(f"""WITH files AS (SELECT {views.duck(_FILES)} FROM documents), coded AS (SELECT *, CASE WHEN NOT found THEN 'file_not_found' WHEN lower(extension) NOT IN ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.webp') THEN 'unsupported_format'
 WHEN file_size < 100 THEN 'file_too_small' WHEN file_size > 50 * 1024 * 1024 THEN 'file_too_large' WHEN width = 0 OR height = 0 THEN 'invalid_dimensions' WHEN width < 100 THEN 'width_too_small' WHEN height < 100 THEN 'height_too_small' ELSE 'ok' END AS code FROM files)
 SELECT doc_id, code, code = 'ok' AS is_valid, CASE WHEN code = 'ok' THEN width / CAST(height AS DOUBLE) END AS aspect_ratio, CASE WHEN code = 'ok' THEN width * height / 1e6 END AS megapixels FROM coded""")
def basic_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "documents").selectExpr(*_FILES)
    code = specs.validation(*[F.col(c) for c in ("found", "extension", "file_size", "width", "height")])
    ok = F.col("code") == "ok"
    coded = f.withColumn("code", code)
    return coded.select("doc_id", "code", ok.alias("is_valid"), F.when(ok, F.col("width") / F.col("height")).alias("aspect_ratio"), F.when(ok, F.col("width") * F.col("height") / F.lit(1e6)).alias("megapixels"))


@query(f"WITH {views.ASSETS_SQL} SELECT doc_id, CASE WHEN least(width, height) < 800 THEN 'too small' WHEN greatest(width, height) > 4000 THEN 'too large' ELSE 'ok' END AS verdict FROM assets")
def fallback_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.assets(spark, sf_dir).select("doc_id", specs.fallback_spec(F.col("width"), F.col("height")).alias("verdict"))


@query(f"WITH {views.ASSETS_SQL} SELECT doc_id, CASE WHEN sqrt(width * height / (1920.0::DOUBLE * 1080)) < 0.5 THEN 21.0::DOUBLE WHEN sqrt(width * height / (1920.0::DOUBLE * 1080)) > 2 THEN 36.0::DOUBLE ELSE 30.0::DOUBLE END AS threshold FROM assets")
def resolution_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.assets(spark, sf_dir).select("doc_id", tiers.adapted_threshold(F.col("width"), F.col("height")).alias("threshold"))


@query(f"""WITH {views.ASSETS_SQL}, named AS (SELECT doc_id, format AS category, 'img' || CAST(doc_id % 50 AS VARCHAR) || '.' || lower(format) AS filename FROM assets),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY category, filename ORDER BY doc_id) - 1 AS n FROM named)
 SELECT doc_id, category, CASE WHEN n = 0 THEN filename ELSE split_part(filename, '.', 1) || '_' || n || '.' || split_part(filename, '.', 2) END AS target FROM ranked""")
def suffix_on_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.assets(spark, sf_dir).select("doc_id", F.col("format").alias("category"), F.concat(F.lit("img"), (F.col("doc_id") % 50).cast("string"), F.lit("."), F.lower("format")).alias("filename"))
    return specs.with_clash_names(files, path="doc_id").select("doc_id", "category", "target")


_FOLDER = "CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id * 37 % 201 > 60 THEN 'invalid' WHEN doc_id * 37 % 201 >= 50 THEN 'manualreview' ELSE 'valid' END"


@query(f"""WITH p AS (SELECT doc_id, 'img' || CAST(doc_id % 50 AS VARCHAR) || '.png' AS filename, {_FOLDER} AS folder FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY folder, filename ORDER BY doc_id) - 1 AS n, max(doc_id) OVER (PARTITION BY folder, filename) AS last FROM p)
 SELECT doc_id, folder, CASE WHEN folder IS NULL THEN NULL WHEN n = 0 THEN folder || '/' || filename ELSE folder || '/' || split_part(filename, '.', 1) || '_' || n || '.png' END AS suffixed,
 CASE WHEN doc_id = last AND folder IS NOT NULL THEN folder || '/' || filename END AS overwritten FROM r""")
def copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('img', CAST(doc_id % 50 AS STRING), '.png') AS filename", f"{_ED} AS s")
    tiered = p.withColumn("status", tiers.editing_tier(F.col("s")))
    both = [copies.copy_plan(tiered, "tier", path="doc_id", clash=c) for c in ("suffix", "last")]
    return both[0].select("doc_id", "folder", F.col("target").alias("suffixed")).join(both[1].select("doc_id", F.col("target").alias("overwritten")), "doc_id")


# --- tiers -------------------------------------------------------------------------------------------------------

_WM = "CAST(doc_id * 29 % 201 AS DOUBLE) / 2"
_HAS = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END"


@query(f"""WITH p AS (SELECT doc_id, {_WM} AS pct, {_HAS} AS has FROM documents) SELECT doc_id,
 CASE WHEN has IS NULL THEN 'error' WHEN has AND pct > 96 THEN 'fail' WHEN has AND pct > 91 THEN 'manual' ELSE 'pass' END AS standalone,
 CASE WHEN has IS NULL THEN 'fail' WHEN has AND pct >= 96 THEN 'fail' WHEN has AND pct >= 91 THEN 'manual' ELSE 'pass' END AS summary,
 CASE WHEN pct > 96 THEN 'fail' WHEN pct > 91 THEN 'manual' ELSE 'pass' END AS compat, coalesce(has AND pct > 95, false) AS flagged FROM p""")
def watermark_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_WM} AS pct", f"{_HAS} AS has")
    has, pct = F.col("has"), F.col("pct")
    return p.select("doc_id", tiers.watermark_tier(has, pct).alias("standalone"), tiers.watermark_summary_tier(has, pct).alias("summary"), tiers.watermark_compat_tier(pct).alias("compat"), tiers.watermark_flagged(has, pct).alias("flagged"))


_ED = "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(doc_id * 37 % 201 AS DOUBLE) / 2 END"


@query(f"""WITH p AS (SELECT doc_id, {_ED} AS s FROM documents) SELECT doc_id,
 CASE WHEN s IS NULL THEN 'error' WHEN s > 30 THEN 'fail' WHEN s >= 25 THEN 'manual' ELSE 'pass' END AS standalone,
 CASE WHEN s IS NULL THEN 'pass' WHEN s >= 25 THEN 'fail' WHEN s >= 20 THEN 'manual' ELSE 'pass' END AS pipeline,
 CASE WHEN s IS NULL THEN 'error' WHEN s >= 30 THEN 'fail' WHEN s >= 25 THEN 'manual' ELSE 'pass' END AS in_table,
 CASE WHEN s > 30 THEN 'Invalid - heavily edited' WHEN s >= 25 THEN 'Manual review needed' WHEN s >= 18 THEN 'Possible light editing' ELSE 'Minimal/natural editing' END AS display,
 CASE WHEN s >= 75 THEN 'Heavy Editing Detected' WHEN s >= 60 THEN 'Moderate Editing Detected' WHEN s >= 40 THEN 'Light Editing Detected' ELSE 'Natural/Minimal Editing' END AS category FROM p""")
def editing_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    p = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_ED} AS s")
    return p.select("doc_id", tiers.editing_tier(s).alias("standalone"), tiers.editing_pipeline_tier(s).alias("pipeline"), tiers.editing_table_tier(s).alias("in_table"), tiers.editing_display(s).alias("display"), tiers.editing_category(s).alias("category"))


@query(f"""WITH {views.DETECTIONS_SQL}, p AS (SELECT doc_id, s_simple AS conf, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE s_simple > 0.1 END AS simple, s_frame > 0.9 AS frame, s_texture > 0.95 AS textured FROM detections),
 f AS (SELECT doc_id, conf, conf > 0.15 AND coalesce(simple, true) AS simple, conf > 0.15 AND frame AS frame, conf > 0.15 AND textured AS textured FROM p)
 SELECT doc_id, CASE WHEN conf >= 0.58 THEN 'fail' WHEN conf >= 0.35 THEN 'manual' ELSE 'pass' END AS tier, simple, CASE WHEN simple OR frame OR textured THEN 'fail' ELSE 'pass' END AS by_flags,
 CASE WHEN conf >= 0.35 AND conf < 0.58 THEN 'Manual Review' WHEN simple THEN 'Simple Border' WHEN textured THEN 'Textured Frame' WHEN frame THEN 'Frame Structure' ELSE 'No Border' END AS label FROM f""")
def border_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    c = F.col("s_simple")
    flags = d.select(
        "doc_id",
        c.alias("conf"),
        tiers.border_settled_flag(F.when(F.col("doc_id") % 7 != 0, c > 0.1), c).alias("simple"),
        tiers.border_settled_flag(F.col("s_frame") > 0.9, c).alias("frame"),
        tiers.border_settled_flag(F.col("s_texture") > 0.95, c).alias("textured"),
    )
    tier = tiers.border_tier(F.col("conf"))
    shapes = F.col("simple"), F.col("frame"), F.col("textured")
    return flags.select("doc_id", tier.alias("tier"), "simple", tiers.border_flag_verdict(*shapes).alias("by_flags"), tiers.border_label(tier == "manual", shapes[0], shapes[2], shapes[1]).alias("label"))


_MSG = "CASE doc_id % 7 WHEN 0 THEN 'Unknown exception on CUDA' WHEN 1 THEN 'GPU error' WHEN 2 THEN 'Textline failed' WHEN 3 THEN 'Could not load file' WHEN 4 THEN 'Out of memory' WHEN 5 THEN NULL ELSE 'odd' END"


@query(f"""WITH p AS (SELECT doc_id, {_MSG} AS m FROM documents) SELECT doc_id, CASE WHEN m IS NULL THEN NULL WHEN lower(m) LIKE '%unknown exception%' THEN 'paddle_unknown_exception' WHEN lower(m) LIKE '%orientation%' OR lower(m) LIKE '%textline%' THEN 'paddle_orientation_issue'
 WHEN lower(m) LIKE '%memory%' OR lower(m) LIKE '%cuda%' OR lower(m) LIKE '%gpu%' THEN 'paddle_resource_issue' WHEN lower(m) LIKE '%could not load%' THEN 'image_load_error' ELSE 'general_error' END AS kind FROM p""")
def error_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MSG} AS m").select("doc_id", tiers.error_kind(F.col("m")).alias("kind"))


# --- text in images ----------------------------------------------------------------------------------------------

_CLEAN = f"lower(regexp_replace(text, '^[{ocr.SPACES}]+|[{ocr.SPACES}]+$', '', 'g'))"
_NOISE = rf"""(length({_CLEAN}) <= 3 AND len(list_distinct(string_split({_CLEAN}, ''))) = 1 AND length({_CLEAN}) > 0
 OR length({_CLEAN}) >= 4 AND len(list_distinct(string_split({_CLEAN}, ''))) / length({_CLEAN}) < 0.3 OR regexp_matches({_CLEAN}, '^[^\p{{L}}\p{{N}}_\s]{{2,}}$'))"""
_KEEP = rf"(confidence >= 0.6 AND length(text) BETWEEN 1 AND 500 AND w * h >= 50 AND regexp_matches(text, '\S') AND NOT {_NOISE})"
_METRICS = f"""{views.OCR_SQL}, judged AS (SELECT *, {_KEEP} AS kept FROM ocr), metrics AS (SELECT image, count(*) FILTER (kept) AS n_texts, coalesce(avg(confidence) FILTER (kept) * 100, 0) AS average_confidence,
 coalesce(avg(detection) FILTER (kept) * 100, 0) AS detection_confidence, coalesce(avg(recognition) FILTER (kept) * 100, 0) AS recognition_confidence, count(*) FILTER (kept AND confidence >= 0.8) AS n_high, count(*) FILTER (kept AND confidence >= 0.5 AND confidence < 0.8) AS n_medium,
 count(*) FILTER (kept AND confidence < 0.5) AS n_low, CAST(coalesce(sum(length(text)) FILTER (kept), 0) AS BIGINT) AS text_length,
 coalesce(sum(length(text) * confidence * confidence) FILTER (kept) / nullif(sum(length(text) * confidence) FILTER (kept), 0) * 100, 0) AS overall_confidence FROM judged GROUP BY image),
 tiered AS (SELECT image, n_texts, overall_confidence, CASE WHEN overall_confidence > 80 OR n_texts > 5 THEN 'fail' WHEN overall_confidence > 60 OR n_texts > 2 THEN 'manual' ELSE 'pass' END AS status,
 NOT (overall_confidence > 60 OR n_texts > 2) AS unified_pass FROM metrics)"""


def _kept() -> Column:
    return ocr.keep_text(F.col("text"), F.col("confidence"), F.col("w"), F.col("h"))


@query(f"WITH {views.OCR_SQL} SELECT image, nth, text, {_NOISE} AS noise, {_KEEP} AS kept FROM ocr")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ocr(spark, sf_dir).select("image", "nth", "text", ocr.is_noise(F.col("text")).alias("noise"), _kept().alias("kept"))


@query(f"""WITH {_METRICS} SELECT image, n_texts, round(average_confidence, 6) AS average_confidence, round(detection_confidence, 6) AS detection_confidence, round(recognition_confidence, 6) AS recognition_confidence, n_high, n_medium, n_low, text_length,
 round(overall_confidence, 6) AS overall_confidence FROM metrics""")
def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ocr.confidence_metrics(views.ocr(spark, sf_dir), _kept()))


@query(f"WITH {_METRICS} SELECT image, n_texts, status, unified_pass FROM tiered")
def text_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.text_tiers(views.ocr(spark, sf_dir), _kept()).drop("overall_confidence")


@query(f"""WITH {_METRICS} SELECT count(*) AS n_images, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'manual') AS n_manual, count(*) FILTER (status = 'pass') AS n_pass,
 round(avg(overall_confidence), 6) AS mean, round(median(round(overall_confidence, 2)), 6) AS median, round(min(overall_confidence), 6) AS least, round(max(overall_confidence), 6) AS most,
 round(stddev_pop(overall_confidence), 6) AS deviation, CAST(sum(n_texts) AS BIGINT) AS n_texts FROM tiered""")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ocr.batch_stats(ocr.text_tiers(views.ocr(spark, sf_dir), _kept())))


# --- verdicts ----------------------------------------------------------------------------------------------------

_V = views.VERDICTS_SQL


def _run_all_sql(manual: str) -> str:
    return f"""WITH {_V}, g AS (SELECT doc_id, filename, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER ({manual}) AS n_manual,
 coalesce(string_agg(test, ';' ORDER BY test_ord) FILTER (status = 'fail'), '') AS failed, coalesce(string_agg(test, ';' ORDER BY test_ord) FILTER ({manual}), '') AS reviewed FROM verdicts GROUP BY doc_id, filename)
 SELECT doc_id, filename, n_fail, n_manual, CASE WHEN n_fail > 0 THEN 'invalid' WHEN n_manual > 0 THEN 'manual_review' ELSE 'valid' END AS category, CASE WHEN n_fail > 0 THEN failed ELSE reviewed END AS tests FROM g"""


@query(_run_all_sql("status = 'manual'"))
def run_all_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.run_all(views.verdicts(spark, sf_dir), KEY)


@query(_run_all_sql("status = 'manual' AND test <> 'quality'"))
def run_all_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.run_all(views.verdicts(spark, sf_dir), KEY, advisory="quality")


_STOPPED = f"""WITH {_V}, f AS (SELECT doc_id, min(test_ord) AS ord FROM verdicts WHERE status <> 'pass' GROUP BY doc_id),
 s AS (SELECT v.doc_id, v.filename, f.ord, v.test, v.test_ord, v.status FROM verdicts v LEFT JOIN f USING (doc_id))"""


@query(f"""{_STOPPED} SELECT doc_id, filename, count(*) FILTER (ord IS NULL OR test_ord <= ord) AS n_run, max(test) FILTER (test_ord = ord) AS stopped_by,
 CASE WHEN max(ord) IS NULL THEN 'valid' WHEN max(status) FILTER (test_ord = ord) = 'manual' THEN 'manual_review' ELSE 'invalid' END AS category FROM s GROUP BY doc_id, filename""")
def sequential_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.stop_at_first(views.verdicts(spark, sf_dir), KEY)


@query(f"{_STOPPED} SELECT doc_id, test, status FROM s WHERE ord IS NULL OR test_ord <= ord")
def sequential_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.evaluated(views.verdicts(spark, sf_dir), ["doc_id"]).select("doc_id", "test", "status")


@query(f"{_STOPPED} SELECT doc_id, max(ord) IS NULL AS is_valid, coalesce(max(test) FILTER (test_ord = ord), 'valid') AS category FROM s GROUP BY doc_id")
def drop_in_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.drop_in(views.verdicts(spark, sf_dir), ["doc_id"])


_MEMBERS = f"""WITH {_V}, f AS (SELECT doc_id, min(test_ord) AS ord FROM verdicts WHERE status = 'fail' GROUP BY doc_id),
 filed AS (SELECT v.doc_id, v.filename, CASE WHEN status = 'fail' THEN 'invalid' ELSE 'manual_review' END AS category, test FROM verdicts v LEFT JOIN f USING (doc_id)
 WHERE status = 'fail' OR status = 'manual' AND (f.ord IS NULL OR test_ord < f.ord)),
 members AS (SELECT * FROM filed UNION ALL SELECT doc_id, filename, 'valid', NULL FROM assets a WHERE NOT EXISTS (SELECT 1 FROM filed WHERE filed.doc_id = a.doc_id))"""


@query(f"{_MEMBERS} SELECT doc_id, filename, category, test FROM members")
def routine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.memberships(views.verdicts(spark, sf_dir), KEY)


@query(f"{_MEMBERS} SELECT doc_id, CASE WHEN bool_or(category = 'invalid') THEN 'invalid' WHEN bool_or(category = 'manual_review') THEN 'manual_review' ELSE 'valid' END AS category, count(*) AS n_memberships FROM members GROUP BY doc_id")
def final_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.final_categories(routine_scan(spark, sf_dir), ["doc_id"])


@query(f"""{_MEMBERS}, c AS (SELECT 'invalid' AS category, unnest(['specifications', 'border', 'watermark', 'quality']) AS test UNION ALL SELECT 'manual_review', unnest(['specifications', 'border', 'watermark', 'quality']) UNION ALL SELECT 'valid', '')
 SELECT c.category, c.test, count(m.doc_id) AS n FROM c LEFT JOIN members m ON m.category = c.category AND coalesce(m.test, '') = c.test GROUP BY c.category, c.test""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, t) for c in ("invalid", "manual_review") for t in views.STEPS] + [("valid", "")]
    return verdicts.category_counts(routine_scan(spark, sf_dir), spark.createDataFrame(rows, "category string, test string"))


@query(f"WITH {_V} SELECT doc_id, filename FROM assets a WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.filename = a.filename AND v.status <> 'pass')")
def valid_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.verdicts(spark, sf_dir)
    return verdicts.unflagged(views.assets(spark, sf_dir).select("doc_id", "filename"), v.where("status <> 'pass'"))


@query(f"""{_run_all_sql("status = 'manual'").replace(" SELECT doc_id, filename, n_fail", ", r AS (SELECT doc_id, filename, n_fail")}) SELECT count(*) AS total, count(*) FILTER (category = 'valid') AS n_valid, count(*) FILTER (category = 'manual_review') AS n_manual,
 count(*) FILTER (category = 'invalid') AS n_invalid, count(*) FILTER (category = 'valid') * 100.0::DOUBLE / count(*) AS success_rate FROM r""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.verdict_counts(run_all_verdict(spark, sf_dir))


@query(f"""WITH {_V}, r AS (SELECT doc_id, 'Failed checks: ' || string_agg(test || ': ' || status || ' at ' || CAST(test_ord AS VARCHAR), '; ' ORDER BY test_ord) AS reason FROM verdicts WHERE status <> 'pass' GROUP BY doc_id),
 s AS (SELECT doc_id, string_split(substring(reason, 16), '; ') AS parts FROM r), x AS (SELECT doc_id, unnest(parts) AS one, unnest(range(len(parts))) AS nth FROM s)
 SELECT doc_id, nth, split_part(one, ': ', 1) AS check, split_part(one, ': ', 2) AS detail FROM x""".replace(" AS check", ' AS "check"'))
def reason_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.struct("test_ord", F.concat("test", F.lit(": "), "status", F.lit(" at "), F.col("test_ord").cast("string")).alias("part"))
    flagged = views.verdicts(spark, sf_dir).where("status <> 'pass'").groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    rows = flagged.select("doc_id", F.concat(F.lit("Failed checks: "), F.array_join(F.col("p")["part"], "; ")).alias("reason"))
    return reports.parsed_reasons(rows).drop("reason")


@query(f"WITH {_V} SELECT test, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'manual') AS manual, count(*) FILTER (status = 'pass') AS pass FROM verdicts GROUP BY test")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confusion(views.verdicts(spark, sf_dir), "test", "status", ["fail", "manual", "pass"])


# --- scores ------------------------------------------------------------------------------------------------------


def _knots_sql(x: str, a: float, b: float, c: float, tail: float) -> str:
    return f"CASE WHEN {x} <= {a} THEN 0.0::DOUBLE WHEN {x} <= {b} THEN ({x} - {a}) / ({b} - {a}) * 50 WHEN {x} <= {c} THEN 50 + ({x} - {b}) / ({c} - {b}) * 35 ELSE least(95.0::DOUBLE, 85 + ({x} - {c}) / {tail} * 10) END"


_NORM = f"""{views.SCORES_SQL}, norm AS (SELECT *, {_knots_sql("brisque", 31.4, 58.2, 80.5, 20)} AS b, {_knots_sql("niqe", 4.2, 7.8, 12.5, 8)} AS q,
 CASE WHEN clipiqa > 1 OR clipiqa < 0.1 OR clipiqa > 0.9 THEN NULL WHEN clipiqa >= 0.75 THEN 0.0::DOUBLE WHEN clipiqa >= 0.55 THEN (0.75 - clipiqa) / 0.20 * 40 ELSE 40 + (0.55 - clipiqa) / 0.45 * 50 END AS c FROM scores),
 avg_ AS (SELECT *, CASE WHEN c IS NULL THEN 2 ELSE 3 END AS n, (b + q + coalesce(c, 0)) / CASE WHEN c IS NULL THEN 2 ELSE 3 END AS quality FROM norm),
 feat AS (SELECT *, least(100.0::DOUBLE, (
   CASE WHEN clipping > 5 THEN least(90.0::DOUBLE, 60 + (clipping - 5) / 10 * 30) WHEN clipping > 1 THEN 30 + (clipping - 1) / 4 * 30 WHEN clipping > 0.1 THEN clipping * 30 ELSE 0 END
   + CASE WHEN entropy < 6.5 THEN (6.5 - entropy) / 6.5 * 70 WHEN entropy > 7.7 THEN (entropy - 7.7) / 0.5 * 40 ELSE 0 END
   + CASE WHEN ks > 0.15 THEN least(60.0::DOUBLE, (ks - 0.15) / 0.35 * 60) ELSE 0 END) / 3) AS hist,
  least(100.0::DOUBLE, (
   CASE WHEN laplacian > 10000 THEN least(85.0::DOUBLE, 60 + (laplacian - 10000) / 20000 * 25) WHEN laplacian > 2000 THEN (laplacian - 2000) / 8000 * 60 WHEN laplacian < 100 THEN (100 - laplacian) / 100 * 50 ELSE 0 END
   + CASE WHEN density > 0.15 THEN least(70.0::DOUBLE, (density - 0.15) / 0.25 * 70) WHEN density < 0.05 THEN (0.05 - density) / 0.05 * 40 ELSE 0 END
   + CASE WHEN high > 5000 THEN least(75.0::DOUBLE, (high - 5000) / 15000 * 75) WHEN high < 500 THEN (500 - high) / 500 * 30 ELSE 0 END) / 3) AS edge,
  least(100.0::DOUBLE, (CASE WHEN ratio > 0.15 OR ratio < 0.03 THEN least(60.0::DOUBLE, abs(ratio - 0.09) / 0.1 * 60) ELSE 0 END
   + CASE WHEN variance > 2 THEN least(40.0::DOUBLE, (variance - 2) / 8 * 40) WHEN variance < 0.5 THEN (0.5 - variance) / 0.5 * 25 ELSE 0 END) / 2) AS freq FROM avg_),
 total AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN quality < 30 AND (hist + edge + freq) / 3 > 25 THEN least(100.0::DOUBLE, (quality * 0.3 + hist * 0.3 + edge * 0.3 + freq * 0.1) * 1.4)
   WHEN abs(quality - (hist + edge + freq) / 3) > 30 THEN quality * 0.6 + hist * 0.15 + edge * 0.15 + freq * 0.1 ELSE quality * 0.7 + hist * 0.12 + edge * 0.12 + freq * 0.06 END)) AS overall FROM feat)"""


@query(f"WITH {_NORM} SELECT p_partkey, round(b, 6) AS brisque_norm, round(q, 6) AS niqe_norm, round(c, 6) AS clipiqa_norm, n AS n_models, round(quality, 6) AS quality FROM avg_")
def model_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normed(spark, sf_dir).select("p_partkey", F.round("b", 6).alias("brisque_norm"), F.round("q", 6).alias("niqe_norm"), F.round("c", 6).alias("clipiqa_norm"), F.col("n").alias("n_models"), F.round("quality", 6).alias("quality"))


def _normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir).withColumns({"b": sc.brisque_norm(F.col("brisque")), "q": sc.niqe_norm(F.col("niqe")), "c": sc.clipiqa_norm(F.col("clipiqa"))})
    three = F.col("b"), F.col("q"), F.col("c")
    return s.withColumns({"n": sc.model_count(*three), "quality": sc.model_average(*three)})


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _normed(spark, sf_dir).withColumns(
        {
            "hist": sc.histogram_score(F.col("clipping"), F.col("entropy"), F.col("ks")),
            "edge": sc.edge_score(F.col("laplacian"), F.col("density"), F.col("high")),
            "freq": sc.frequency_score(F.col("ratio"), F.col("variance")),
        }
    )
    return f.withColumn("overall", sc.overall_score(F.col("n"), F.col("quality"), F.col("hist"), F.col("edge"), F.col("freq")))


@query(f"WITH {_NORM} SELECT p_partkey, round(hist, 6) AS hist, round(edge, 6) AS edge, round(freq, 6) AS freq, round(overall, 6) AS overall FROM total")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).select("p_partkey", *[F.round(c, 6).alias(c) for c in ("hist", "edge", "freq", "overall")])


@query(f"""WITH {_NORM}, pts AS (SELECT p_partkey, 3 + CASE WHEN sqrt((pow(hist - (hist + edge + freq) / 3, 2) + pow(edge - (hist + edge + freq) / 3, 2) + pow(freq - (hist + edge + freq) / 3, 2)) / 3) < 10 THEN 2
 WHEN sqrt((pow(hist - (hist + edge + freq) / 3, 2) + pow(edge - (hist + edge + freq) / 3, 2) + pow(freq - (hist + edge + freq) / 3, 2)) / 3) < 20 THEN 1 ELSE 0 END + CASE WHEN overall > 70 OR overall < 30 THEN 1 ELSE 0 END AS p FROM total)
 SELECT p_partkey, ['Very Low', 'Low', 'Medium', 'High', 'Very High', 'Extremely High'][least(p, 5) + 1] AS confidence FROM pts""")
def confidence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _totals(spark, sf_dir)
    return t.select("p_partkey", sc.confidence_label(F.col("n"), F.col("hist"), F.col("edge"), F.col("freq"), F.col("overall")).alias("confidence"))


@query(f"""WITH {views.DETECTIONS_SQL}, b AS (SELECT *, greatest(s_obvious, s_simple * 0.8, s_frame * 0.7, s_texture * 0.6) AS base FROM detections),
 a AS (SELECT doc_id, base * CASE WHEN noise > 25 THEN greatest(0.7::DOUBLE, 1 - (noise - 25) / 50) ELSE 1.0::DOUBLE END * CASE WHEN uniform AND base > 0.58 THEN 1.1::DOUBLE WHEN uniform THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END
 * CASE WHEN artifacts THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN vignette > 0.5 AND base < 0.58 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS x FROM b)
 SELECT doc_id, {_ROUND.format("greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN x < 0.2 THEN x * 0.8 WHEN x > 0.8 THEN 0.8 + (x - 0.8) * 0.5 ELSE x END))")} AS confidence FROM a""")
def robust_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"s_{m}").alias("score")) for m in ("obvious", "simple", "frame", "texture")])
    d = views.detections(spark, sf_dir)
    return d.select("doc_id", _round(sc.robust_confidence(methods, F.col("noise"), F.col("uniform"), F.col("artifacts"), F.col("vignette"))).alias("confidence"))


@query(f"""WITH {views.SCORES_SQL} SELECT p_partkey, array_to_string(list_filter([CASE WHEN brisque > 65 THEN 'brisque: significant degradation' WHEN brisque > 45 THEN 'brisque: moderate issues' WHEN brisque < 25 THEN 'brisque: excellent' END,
 CASE WHEN niqe > 10 THEN 'niqe: poor naturalness' WHEN niqe > 6 THEN 'niqe: reduced naturalness' WHEN niqe < 4 THEN 'niqe: excellent' END, CASE WHEN clipiqa > 0.7 THEN 'clipiqa: high quality' WHEN clipiqa < 0.4 THEN 'clipiqa: poor quality' END,
 CASE WHEN clipping > 2 THEN 'clipping: tone mapping or exposure' END, CASE WHEN entropy > 7.9 THEN 'entropy: artificial enhancement' WHEN entropy < 6.0 THEN 'entropy: tone manipulation' END,
 CASE WHEN laplacian > 3000 THEN 'laplacian: artificial sharpening' WHEN laplacian < 50 THEN 'laplacian: over-smoothing' END, CASE WHEN density > 0.2 THEN 'edges: over-enhancement' WHEN density < 0.03 THEN 'edges: blur or smoothing' END,
 CASE WHEN ratio > 0.25 THEN 'frequencies: artificial enhancement' WHEN ratio < 0.02 THEN 'frequencies: over-smoothing' END], lambda x: x IS NOT NULL), '; ') AS findings FROM scores""")
def interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir)
    found = tiers.interpretation(*[F.col(c) for c in ("brisque", "niqe", "clipiqa", "clipping", "entropy", "laplacian", "density", "ratio")])
    return s.select("p_partkey", F.array_join(found, "; ").alias("findings"))


@query(f"""WITH {views.DETECTIONS_SQL}, p AS (SELECT *, CASE WHEN s_obvious >= greatest(s_simple, s_frame, s_texture) THEN 'obvious' WHEN s_simple >= greatest(s_frame, s_texture) THEN 'simple' WHEN s_frame >= s_texture THEN 'frame' ELSE 'texture' END AS m FROM detections)
 SELECT doc_id, CASE WHEN greatest(s_simple, s_frame, s_texture) > 0.5 THEN CASE WHEN m = 'obvious' THEN 'obvious border' WHEN m = 'simple' AND uniform THEN 'simple uniform border' WHEN m = 'simple' THEN 'simple border by color or texture'
 WHEN m = 'frame' THEN 'frame by contours' ELSE 'textured border' END WHEN vignette > 0.5 THEN 'vignette without border' WHEN artifacts THEN 'compression artifacts without border' WHEN uniform THEN 'uniform background without border' ELSE 'no border or frame' END AS reason FROM p""")
def border_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    methods = F.array(*[F.struct(F.col(f"s_{m}").alias("s"), F.lit(-i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(("obvious", "simple", "frame", "texture"))])
    found = F.greatest("s_simple", "s_frame", "s_texture") > 0.5
    return d.select("doc_id", tiers.border_reason(found, F.array_max(methods)["m"], F.col("vignette"), F.col("artifacts"), F.col("uniform")).alias("reason"))


# --- pictures ----------------------------------------------------------------------------------------------------

_P = views.PIXELS_SQL


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


def _measured(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return pictures.measured(views.pictures(spark, sf_dir, bool({"colour", "levels"} & set(parts))), *parts)


def _picture(measured: DataFrame, found: Column) -> DataFrame:
    """image and the fields of a struct of findings, rounded."""
    return _rounded(measured.select("image", found.alias("v")).select("image", "v.*"))


@query(f"""WITH {_P}, h AS (SELECT image, gray, count(*) / 4096.0::DOUBLE AS p FROM pixels GROUP BY image, gray), ids AS (SELECT DISTINCT image FROM pixels),
 f AS (SELECT i.image, b.range::INT AS bin, coalesce(h.p, 0) AS p FROM ids i CROSS JOIN range(256) b LEFT JOIN h ON h.image = i.image AND h.gray = b.range),
 w AS (SELECT *, lag(p) OVER o AS before, lead(p) OVER o AS after, sum(p) OVER o AS cum, max(p) OVER (PARTITION BY image) AS top FROM f WINDOW o AS (PARTITION BY image ORDER BY bin)),
 e AS (SELECT image, p, top, lag(p) OVER o AS before, lead(p) OVER o AS after FROM w WHERE before IS NULL OR p <> before WINDOW o AS (PARTITION BY image ORDER BY bin)),
 k AS (SELECT image, count(*) FILTER (p > before AND p > after AND p >= top * 0.1) AS n FROM e GROUP BY image)
 SELECT image, round(sum(p) FILTER (bin = 0) * 100, 6) AS black_clipping, round(sum(p) FILTER (bin = 255) * 100, 6) AS white_clipping, round(sum(p) FILTER (bin IN (0, 255)) * 100, 6) AS total_clipping,
 round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS entropy, round(1 / (1 + var_pop(p - before)), 6) AS smoothness, any_value(k.n) AS n_peaks,
 round(max(abs(cum - (bin + 1) / 256.0::DOUBLE)), 6) AS ks FROM w JOIN k USING (image) GROUP BY image""")
def histogram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pictures.histogram_features(_measured(spark, sf_dir, "hist")))


#: The four sides of a strip of w pixels, as means or deviations named after them.
def _sides(f: str, prefix: str, w: str = "w") -> str:
    return ", ".join(f"{f}(gray) FILTER ({where}) AS {prefix}{s}" for s, where in (("t", f"y < {w}"), ("b", f"y >= 64 - {w}"), ("l", f"x < {w}"), ("r", f"x >= 64 - {w}")))


_STROKE = "(x <= w // 2 OR y <= w // 2 OR x >= 64 - w // 2 OR y >= 64 - w // 2)"
_OUTLINE = "(x BETWEEN w - 2 AND 66 - w AND y BETWEEN w - 2 AND 66 - w AND NOT (x BETWEEN w + 1 AND 63 - w AND y BETWEEN w + 1 AND 63 - w))"
_INSIDE = "(x BETWEEN w AND 64 - w AND y BETWEEN w AND 64 - w)"
_SHADE = """shade AS (SELECT image, avg(gray) FILTER (x BETWEEN 16 AND 48 AND y BETWEEN 16 AND 48) AS centre, [avg(gray) FILTER (x <= 8 AND y <= 8), avg(gray) FILTER (x >= 56 AND y <= 8),
 avg(gray) FILTER (x <= 8 AND y >= 56), avg(gray) FILTER (x >= 56 AND y >= 56)] AS four FROM pixels GROUP BY image),
 shaded AS (SELECT image, centre / (list_avg(four) + 1e-5) AS ratio, least(1.0::DOUBLE, greatest(0.0::DOUBLE, centre / (list_avg(four) + 1e-5) - 1) * (1 - list_stddev_pop(four) / (list_avg(four) + 1e-5))) AS score FROM shade)"""


@query(f"""WITH {_P}, r AS (SELECT image, w, avg(gray) FILTER (least(x, y, 63 - x, 63 - y) >= w) AS c, {_sides("avg", "m")}, {_sides("stddev_pop", "d")} FROM pixels, (SELECT unnest([3, 4, 5, 6]) AS w) GROUP BY image, w),
 a AS (SELECT *, (abs(mt - c) + abs(mb - c) + abs(ml - c) + abs(mr - c)) / 4 AS away, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - (dt + db + dl + dr) / 4 / 30)) AS even,
  abs(mt - c) > 25 AND dt < 15 AS ot, abs(mb - c) > 25 AND db < 15 AS ob, abs(ml - c) > 25 AND dl < 15 AS ol, abs(mr - c) > 25 AND dr < 15 AS ort FROM r),
 s AS (SELECT image, w, ot::INT + ob::INT + ol::INT + ort::INT AS n, away / 25 * even * CASE WHEN ot AND ob THEN 1 - least(1.0::DOUBLE, abs(mt - mb) / (away + 1e-5)) ELSE 1 END * CASE WHEN ol AND ort THEN 1 - least(1.0::DOUBLE, abs(ml - mr) / (away + 1e-5)) ELSE 1 END
  * CASE ot::INT + ob::INT + ol::INT + ort::INT WHEN 4 THEN 1.5::DOUBLE WHEN 3 THEN 1.2::DOUBLE WHEN 2 THEN CASE WHEN ot AND ob OR ol AND ort THEN 1.1::DOUBLE ELSE 1 END ELSE 1 END AS score FROM a),
 b AS (SELECT image, arg_max({{'w': w, 'n': n, 'score': score}}, (score, -w)) FILTER (n > 0 AND score > 0) AS b FROM s GROUP BY image)
 SELECT image, coalesce(b.w, 0) AS border_width, coalesce(b.n, 0) AS n_sides, round(least(1.0::DOUBLE, coalesce(b.score, 0) / 3), 6) AS confidence, coalesce(b.n >= 2 AND least(1.0::DOUBLE, b.score / 3) > 0.6, false) AS detected FROM b""")
def obvious_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "rims"), pictures.obvious())


@query(f"""WITH {_P}, c AS (SELECT image, stddev_pop(gray) AS d FROM pixels GROUP BY image, x // 8, y // 8), s AS (SELECT image, count(*) FILTER (d < 8) / count(*)::DOUBLE AS share FROM c GROUP BY image),
 e AS (SELECT image, {_sides("stddev_pop", "d", "3")} FROM pixels GROUP BY image),
 u AS (SELECT image, share * 0.6 + (4 - least(1.0::DOUBLE, dt / 20) - least(1.0::DOUBLE, db / 20) - least(1.0::DOUBLE, dl / 20) - least(1.0::DOUBLE, dr / 20)) / 4 * 0.4 AS score FROM s JOIN e USING (image))
 SELECT image, round(score, 6) AS score, score > 0.7 AS uniform FROM u""")
def uniform_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "rims", "even"), pictures.uniform())


@query(f"""WITH {_P}, d AS (SELECT image, x, y, abs(gray - lag(gray) OVER (PARTITION BY image, y ORDER BY x)) AS v, abs(gray - lag(gray) OVER (PARTITION BY image, x ORDER BY y)) AS h FROM pixels),
 l AS (SELECT image, 'h' AS way, y AS line, avg(h) AS step FROM d WHERE y % 8 = 0 AND y BETWEEN 8 AND 55 GROUP BY image, y UNION ALL SELECT image, 'v', x, avg(v) FROM d WHERE x % 8 = 0 AND x BETWEEN 8 AND 55 GROUP BY image, x),
 m AS (SELECT image, way, avg(step) AS mean, stddev_pop(step) AS dev FROM l GROUP BY image, way), g AS (SELECT image, way, mean, CASE WHEN dev > 1e-9 THEN mean / (dev + 1e-5) ELSE 0 END AS regular FROM m),
 s AS (SELECT image, max(mean) FILTER (way = 'h') AS horizontal, max(mean) FILTER (way = 'v') AS vertical, least(1.0::DOUBLE, sum(regular) / 10) AS score FROM g GROUP BY image)
 SELECT image, round(horizontal, 6) AS horizontal, round(vertical, 6) AS vertical, round(score, 6) AS score, score > 0.3 AND (horizontal > 2 OR vertical > 2) AS blocky FROM s""")
def block_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "blocks"), pictures.blockiness())


@query(f"WITH {_P}, {_SHADE} SELECT image, round(ratio, 6) AS ratio, round(score, 6) AS score, score > 0.3 AND ratio > 1.2 AS vignetted FROM shaded")
def vignette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "shade"), pictures.vignetting())


@query(f"""WITH {_P}, v AS (SELECT image, (var_pop(gray) FILTER (y < 3) + var_pop(gray) FILTER (y >= 61) + var_pop(gray) FILTER (x < 3) + var_pop(gray) FILTER (x >= 61)) / 4 AS variance FROM pixels GROUP BY image)
 SELECT image, round(variance, 6) AS variance, variance < 200 AS bordered FROM v""")
def edge_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "edge"), pictures.edge_strips())


_PARTS = f"""parts AS (SELECT image, w, any_value(all_dev) AS all_dev, avg(gray) FILTER (WHERE {_STROKE}) AS rim, stddev_pop(gray) FILTER (WHERE {_STROKE}) AS dev, avg(gray) FILTER (WHERE {_INSIDE}) AS inside, {_sides("avg", "m")},
 [avg(gray) FILTER (x < least(2 * w, 15) AND y < least(2 * w, 15)), avg(gray) FILTER (x >= 64 - least(2 * w, 15) AND y < least(2 * w, 15)), avg(gray) FILTER (x < least(2 * w, 15) AND y >= 64 - least(2 * w, 15)), avg(gray) FILTER (x >= 64 - least(2 * w, 15) AND y >= 64 - least(2 * w, 15))] AS corner,
 avg(m) FILTER (WHERE {_OUTLINE}) AS edge FROM grad JOIN spread USING (image), widths GROUP BY image, w),
 rated AS (SELECT image, w, all_dev, abs(rim - inside) AS away, 1 - least(1.0::DOUBLE, dev / greatest(5.0, all_dev) / 2) AS uniformity, 1 - least(1.0::DOUBLE, list_var_pop([mt, mb, ml, mr]) / 400) AS sides,
  CASE WHEN w < 4 THEN 0.8::DOUBLE ELSE 1 - least(1.0::DOUBLE, list_var_pop(corner) / 200) END AS corners, CASE WHEN w > 2 THEN least(1.0::DOUBLE, edge / 30) ELSE 0.5::DOUBLE END AS step FROM parts)"""
_SPREAD = "spread AS (SELECT image, stddev_pop(gray) AS all_dev FROM pixels GROUP BY image)"


@query(f"""WITH {_P}, {views.GRADIENTS_SQL}, {_SPREAD}, widths AS (SELECT 5 AS w), {_PARTS}
 SELECT image, round(uniformity, 6) AS uniformity, round(sides, 6) AS side_consistency, round(corners, 6) AS corner_consistency FROM rated""")
def border_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "hist", "rims"), pictures.statistics())


@query(f"""WITH {_P}, {views.GRADIENTS_SQL}, {_SPREAD}, widths AS (SELECT unnest([2, 3]) AS w), {_PARTS}, {_SHADE},
 scored AS (SELECT image, w, away, CASE WHEN all_dev < 30 THEN 0.35::DOUBLE * 1.2 ELSE 0.35::DOUBLE END AS bar, away >= 15 AND uniformity >= 0.75 AND sides >= 0.70 AS fit, (0.40::DOUBLE * least(1.0::DOUBLE, away / 30) + 0.30::DOUBLE * greatest(0.0::DOUBLE, (uniformity - 0.5) * 2)
  + 0.15::DOUBLE * sides + 0.10::DOUBLE * step + 0.05::DOUBLE * corners) * CASE WHEN all_dev < 30 THEN 0.9::DOUBLE ELSE 1 END AS score FROM rated),
 best AS (SELECT image, any_value(bar) AS bar, arg_max({{'w': w, 'away': away, 'score': score}}, (score, -w)) FILTER (fit) AS b FROM scored GROUP BY image),
 judged AS (SELECT image, coalesce(b.w, 0) AS w, coalesce(b.away, 0) AS away, coalesce(b.score, 0) AS s, bar, s.score > 0.6 AND s.ratio > 1.2 AS dark FROM best JOIN shaded s USING (image))
 SELECT image, w AS border_width, round(away, 6) AS difference, round(CASE WHEN s > bar AND dark AND s < bar * 1.5 THEN s * 0.8 ELSE s END, 6) AS score, s > bar AND NOT (dark AND s < bar * 1.5) AS detected FROM judged""")
def simple_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "hist", "rims", "shade"), pictures.simple())


@query(f"""WITH {_P}, t AS (SELECT image, w, abs(avg(gray) FILTER (WHERE {_STROKE}) - avg(gray) FILTER (WHERE {_INSIDE})) AS away, stddev_pop(gray) FILTER (WHERE {_STROKE}) AS dev FROM pixels, (SELECT unnest([2, 3, 4, 6]) AS w) GROUP BY image, w),
 b AS (SELECT image, coalesce(arg_max(w, (away * (1 - least(1.0::DOUBLE, dev / 30)), -w)) FILTER (away > 15 AND dev < 30), 0) AS w FROM t GROUP BY image)
 SELECT image, w AS border_width, CASE WHEN w > 0 THEN 4 ELSE 0 END AS n_regions, CASE WHEN w > 0 THEN 'top:0,0,64,' || w || ' bottom:0,' || 64 - w || ',64,64 left:0,0,' || w || ',64 right:' || 64 - w || ',0,64,64' ELSE '' END AS regions FROM b""")
def border_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _picture(_measured(spark, sf_dir, "rims"), pictures.region())
    named = F.transform("regions", lambda r: F.concat_ws(":", r["side"], F.concat_ws(",", r["x0"], r["y0"], r["x1"], r["y1"])))
    return found.select("image", "border_width", F.size("regions").alias("n_regions"), F.array_join(named, " ").alias("regions"))


@query(f"""WITH {_P}, {views.GRADIENTS_SQL}, s AS (SELECT image, {_sides("avg", "m", "5")}, {_sides("stddev_pop", "d", "5")}, avg(m) FILTER (WHERE {_OUTLINE.replace("w", "5")}) AS edge FROM grad GROUP BY image),
 e AS (SELECT *, [1 - least(1.0::DOUBLE, dt / 30), 1 - least(1.0::DOUBLE, db / 30), 1 - least(1.0::DOUBLE, dl / 30), 1 - least(1.0::DOUBLE, dr / 30)] AS even FROM s)
 SELECT image, round(list_min(even), 6) AS least_uniformity, round(CASE WHEN list_avg(even) > 0 THEN 1 - list_stddev_pop(even) / list_avg(even) ELSE 1 END, 6) AS side_consistency,
 {_ROUND.format("((1 - least(1.0::DOUBLE, abs(mt - mb) / 50)) + (1 - least(1.0::DOUBLE, abs(ml - mr) / 50))) / 2")} AS symmetry, round(least(1.0::DOUBLE, edge / 50), 6) AS sharpness FROM e""")
def side_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _measured(spark, sf_dir, "rims").select("image", pictures.sides().alias("v")).select("image", "v.*")
    return _rounded(found.withColumn("symmetry", _round(F.col("symmetry"))))


@query(f"""WITH {_P}, h AS (SELECT image, gray // 4 AS bin, count(*) FILTER (y < 9) AS t, count(*) FILTER (y >= 55) AS b, count(*) FILTER (x < 9) AS l, count(*) FILTER (x >= 55) AS r FROM pixels GROUP BY image, gray // 4),
 f AS (SELECT i.image, n.range AS bin, coalesce(t, 0) AS t, coalesce(b, 0) AS b, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM (SELECT DISTINCT image FROM h) i CROSS JOIN range(64) n LEFT JOIN h ON h.image = i.image AND h.bin = n.range),
 s AS (SELECT image, (CASE WHEN var_pop(t) * var_pop(b) > 1e-12 THEN corr(t, b) ELSE 1 END + CASE WHEN var_pop(l) * var_pop(r) > 1e-12 THEN corr(l, r) ELSE 1 END) / 2 AS score FROM f GROUP BY image)
 SELECT image, round(score, 6) AS score, score > 0.7 AS symmetric FROM s""")
def border_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "sides"), pictures.symmetry())


@query(f"""WITH {_P}, {views.GRADIENTS_SQL}, r AS (SELECT image, avg(m) FILTER (NOT (x BETWEEN 9 AND 55 AND y BETWEEN 9 AND 55)) / (avg(m) FILTER (x BETWEEN 9 AND 55 AND y BETWEEN 9 AND 55) + 1e-10) AS ratio FROM grad GROUP BY image)
 SELECT image, round(ratio, 6) AS ratio, ratio > 1.5 AS framed FROM r""")
def gradient_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "slope"), pictures.slope_ratio())


@query(f"""WITH {_P}, s AS (SELECT image, avg(gray) AS m, stddev_pop(gray) AS d, avg(abs(gray - 128)) / 8 AS t, image % 3 * 1000 AS side FROM pixels GROUP BY image)
 SELECT image, CASE WHEN d < 30 THEN greatest(10, floor(m * 0.3::DOUBLE)) WHEN d > 60 THEN greatest(30, floor(m * 0.4::DOUBLE)) ELSE 50 END::BIGINT AS low, CASE WHEN d < 30 THEN greatest(30, floor(m * 0.8::DOUBLE)) WHEN d > 60 THEN greatest(90, floor(m)) ELSE 150 END::BIGINT AS high,
 CASE WHEN d < 20 THEN 21.0::DOUBLE WHEN d > 50 THEN 39.0::DOUBLE ELSE 30.0::DOUBLE END AS contrast, CASE WHEN t < 3 THEN 1.5::DOUBLE WHEN t > 10 THEN 2.16::DOUBLE ELSE 1.8::DOUBLE END AS sensitivity,
 CASE WHEN side < 500 THEN 0.18::DOUBLE WHEN side > 2000 THEN 0.12::DOUBLE ELSE 0.15::DOUBLE END AS perimeter FROM s""")
def statistic_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a stand-in for the texture: how far the levels are from the middle one
    away = F.aggregate(F.transform("m.hist", lambda n, i: n * F.abs(i - 128)), F.lit(0).cast("long"), lambda s, x: s + x) / F.aggregate("m.hist", F.lit(0).cast("long"), lambda s, n: s + n) / 8
    return _picture(_measured(spark, sf_dir, "hist"), tiers.statistic_thresholds(F.col("m.mean"), F.col("m.deviation"), away, F.col("image") % 3 * 1000))


@query(f"""WITH {_P}, {views.COLOURS_SQL}, w AS (SELECT *, 5 AS w FROM colours), s AS (SELECT image, [{", ".join(f"abs(avg({c}) FILTER (WHERE {_STROKE}) - avg({c}) FILTER (WHERE {_INSIDE}))" for c in "rgb")}] AS steps FROM w GROUP BY image)
 SELECT image, round(CASE WHEN list_avg(steps) > 0 THEN 1 - least(1.0::DOUBLE, list_var_pop(steps) / pow(list_avg(steps), 2)) ELSE 0 END, 6) AS colour_consistency FROM s""")
def colour_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "colour"), F.struct(pictures.colour_consistency().alias("colour_consistency")))


@query(f"""WITH {_P}, {views.COLOURS_SQL}, c AS (SELECT image, 'r' AS channel, r AS v FROM colours UNION ALL SELECT image, 'g', g FROM colours UNION ALL SELECT image, 'b', b FROM colours), h AS (SELECT image, channel, v, count(*) AS n FROM c GROUP BY ALL),
 f AS (SELECT i.image, i.channel, b.range AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT image, channel FROM h) i CROSS JOIN range(256) b LEFT JOIN h ON h.image = i.image AND h.channel = i.channel AND h.v = b.range),
 w AS (SELECT *, lag(n) OVER o AS before, lead(n) OVER o AS after FROM f WINDOW o AS (PARTITION BY image, channel ORDER BY v)),
 e AS (SELECT image, channel, -sum(n / 4096.0::DOUBLE * log2(n / 4096.0::DOUBLE + 1e-10)) AS entropy, count(*) FILTER (n > before AND n > after) AS peaks FROM w GROUP BY image, channel),
 t AS (SELECT image, avg(entropy) AS entropy, sum(peaks) AS n_peaks FROM e GROUP BY image), s AS (SELECT *, CASE WHEN entropy < 5 THEN 15 ELSE 0 END + CASE WHEN n_peaks > 30 THEN 10 ELSE 0 END + CASE WHEN entropy < 4 THEN 20 ELSE 0 END AS score FROM t)
 SELECT image, round(entropy, 6) AS entropy, n_peaks, score::DOUBLE AS score, score < 20 AS passed FROM s""")
def fallback_editing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "levels"), pictures.fallback_editing())


_LINEAR = "CASE WHEN {0} / 255.0::DOUBLE > 0.04045 THEN pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4::DOUBLE) ELSE {0} / 255.0::DOUBLE / 12.92 END"
_TONES = f"""lin AS (SELECT *, {", ".join(f"{_LINEAR.format(c)} AS l{c}" for c in "rgb")} FROM colours),
xyz AS (SELECT *, (lr * 0.412453::DOUBLE + lg * 0.357580::DOUBLE + lb * 0.180423::DOUBLE) / 0.950456 AS tx, lr * 0.212671::DOUBLE + lg * 0.715160::DOUBLE + lb * 0.072169::DOUBLE AS ty, (lr * 0.019334::DOUBLE + lg * 0.119193::DOUBLE + lb * 0.950227::DOUBLE) / 1.088754 AS tz FROM lin),
cube AS (SELECT *, {", ".join(f"CASE WHEN t{c} > 0.008856 THEN pow(t{c}, 1 / 3.0::DOUBLE) ELSE t{c} * 7.787 + 16 / 116.0::DOUBLE END AS f{c}" for c in "xyz")}, greatest(r, g, b) AS top, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS span FROM xyz),
turned AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN top = r THEN (g - b) * 60.0::DOUBLE / span WHEN top = g THEN (b - r) * 60.0::DOUBLE / span + 120 ELSE (r - g) * 60.0::DOUBLE / span + 240 END AS turn FROM cube),
tones AS (SELECT image, x, y, round(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) AS gray, round(CASE WHEN turn < 0 THEN turn + 360 ELSE turn END / 2) % 180 AS h, CASE WHEN top = 0 THEN 0 ELSE round(span * 255 / top) END AS s, top AS v,
 round(CASE WHEN ty > 0.008856 THEN fy * 116 - 16 ELSE ty * 903.3 END * 255 / 100) AS l, round((fx - fy) * 500 + 128) AS a, round((fy - fz) * 200 + 128) AS b FROM turned)"""
_MIDDLE = "(x BETWEEN w + 1 AND 63 - w AND y BETWEEN w + 1 AND 63 - w)"
_LINE = "(x BETWEEN w AND 64 - w AND y BETWEEN w AND 64 - w AND NOT (x BETWEEN w + 1 AND 63 - w AND y BETWEEN w + 1 AND 63 - w))"


@query(f"""WITH {_P}, {views.COLOURS_SQL}, {_TONES}, d AS (SELECT image, w, abs(avg(gray) FILTER (WHERE {_STROKE}) - avg(gray) FILTER (WHERE {_LINE})) AS near, stddev_pop(gray) FILTER (WHERE {_STROKE}) AS dev,
 {", ".join(f"abs(avg({c}) FILTER (WHERE {_STROKE}) - avg({c}) FILTER (WHERE {_MIDDLE})) AS d{c}" for c in ("gray", "h", "s", "v", "l", "a", "b"))} FROM tones, (SELECT unnest([1, 3]) AS w) GROUP BY image, w),
 s AS (SELECT image, w, greatest(near, dgray) AS away, greatest(greatest(near, dgray) / 30 * (1 + 0.5::DOUBLE * (1 - least(1.0::DOUBLE, dev / 40))), least(1.5::DOUBLE, least(dh, 180 - dh) / 90), least(1.5::DOUBLE, ds / 128), least(1.5::DOUBLE, dv / 128), least(1.5::DOUBLE, dl / 100), least(1.5::DOUBLE, da / 127), least(1.5::DOUBLE, db / 127)) AS score FROM d),
 b AS (SELECT image, arg_max(away, (score, -w)) AS away, max(score) AS score FROM s GROUP BY image) SELECT image, round(away, 6) AS difference, round(least(1.0::DOUBLE, score / 2), 6) AS confidence, score > 1 AS detected FROM b""")
def colour_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "colour"), pictures.colour_frame())


_BESIDE = "coalesce(lag({0}) OVER {1}, lead({0}) OVER {1}) + coalesce(lead({0}) OVER {1}, lag({0}) OVER {1})"


@query(f"""WITH {_P}, {views.GRADIENTS_SQL}, across AS (SELECT image, x, y, gray, {_BESIDE.format("gray", "r")} AS beside FROM pixels WINDOW r AS (PARTITION BY image, y ORDER BY x)),
 around AS (SELECT image, beside + {_BESIDE.format("gray", "c")} - 4 * gray AS lap, 9 * gray - (beside + gray) - ({_BESIDE.format("(beside + gray)", "c")}) AS high FROM across WINDOW c AS (PARTITION BY image, x ORDER BY y)),
 spread AS (SELECT image, stddev_pop(m) AS contrast FROM grad GROUP BY image)
 SELECT image, round(var_pop(lap), 6) AS laplacian_variance, round(any_value(contrast), 6) AS edge_contrast, round(var_pop(high), 6) AS high_freq_energy FROM around JOIN spread USING (image) GROUP BY image""")
def edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "kernels"), F.struct("m.laplacian_variance", "m.edge_contrast", "m.high_freq_energy"))


#: A picture's spectrum by rows, then by columns: lists of cosines and sines against lists of values.
_WAVES = """waves AS (SELECT k.range AS k, [cos(2 * pi() * ((k.range * x) % 64) / 64) for x in range(64)] AS c, [sin(2 * pi() * ((k.range * x) % 64) / 64) for x in range(64)] AS s FROM range(64) k),
 lines AS (SELECT image, y, list(gray::DOUBLE ORDER BY x) AS g FROM pixels GROUP BY image, y),
 across AS (SELECT image, k AS u, list(list_inner_product(g, c) ORDER BY y) AS re, list(list_inner_product(g, s) ORDER BY y) AS im FROM lines, waves GROUP BY image, k),
 wave AS (SELECT image, u, k AS v, list_inner_product(re, c) - list_inner_product(im, s) AS re, list_inner_product(re, s) + list_inner_product(im, c) AS im FROM across, waves),
 power AS (SELECT image, re * re + im * im AS p, ln(sqrt(re * re + im * im) + 1) AS l, sqrt(pow(least(u, 64 - u), 2) + pow(least(v, 64 - v), 2)) / 32 AS r FROM wave)"""


@query(f"""WITH {_P}, {_WAVES}
 SELECT image, {", ".join(_ROUND.format(f"sum(p) FILTER ({where}) / sum(p)") + f" AS {name}" for name, where in (("low_freq", "r <= 0.3"), ("mid_freq", "r > 0.3 AND r <= 0.7"), ("high_freq", "r > 0.7")))},
 round(var_pop(l), 6) AS frequency_variance, round(sum(p) / 1e6, 3) AS total_millions FROM power GROUP BY image""")
def frequency_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir, "kernels")
    return m.select("image", *[_round(F.col(f"m.{c}")).alias(c) for c in ("low_freq", "mid_freq", "high_freq")], F.round("m.frequency_variance", 6).alias("frequency_variance"), F.round(F.col("m.total_energy") / 1e6, 3).alias("total_millions"))


@query(f"""WITH {_P}, beside AS (SELECT image, x, y, gray, [coalesce(lag(gray) OVER r, gray), gray, coalesce(lead(gray) OVER r, gray)] AS near FROM pixels WINDOW r AS (PARTITION BY image, y ORDER BY x)),
 around AS (SELECT image, gray, list_sort(list_concat(coalesce(lag(near) OVER c, near), near, coalesce(lead(near) OVER c, near)))[5] AS mid FROM beside WINDOW c AS (PARTITION BY image, x ORDER BY y))
 SELECT image, round(stddev_pop((gray - mid + 256) % 256), 6) AS noise FROM around GROUP BY image""")
def noise_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "kernels"), F.struct("m.noise"))


#: Sizes that the pictures are brought to, and each one's way: areas as they shrink, cubic as they grow.
_RESIZED = {"small": 40, "large": 100}


def _taps(n: int) -> str:
    """SQL of (i, x, k): how much each of 64 places counts for each of ``n``."""
    if n < 64:
        return f"SELECT i.range AS i, x.range AS x, (least((i.range + 1) * 64.0::DOUBLE / {n}, x.range + 1) - greatest(i.range * 64.0::DOUBLE / {n}, x.range)) / (64.0::DOUBLE / {n}) AS k FROM range({n}) i, range(64) x WHERE least((i.range + 1) * 64.0::DOUBLE / {n}, x.range + 1) > greatest(i.range * 64.0::DOUBLE / {n}, x.range)"
    return f"""SELECT i, greatest(0, least(63, f + d - 1)) AS x, sum(CASE WHEN d IN (1, 2) THEN (1.25::DOUBLE * t - 2.25::DOUBLE) * t * t + 1 ELSE ((-0.75::DOUBLE * t + 3.75::DOUBLE) * t - 6) * t + 3 END) AS k
 FROM (SELECT i, f, d.range AS d, abs(o - f - d.range + 1) AS t FROM (SELECT i.range AS i, (i.range + 0.5::DOUBLE) * 64 / {n} - 0.5::DOUBLE AS o, CAST(floor((i.range + 0.5::DOUBLE) * 64 / {n} - 0.5::DOUBLE) AS BIGINT) AS f FROM range({n}) i), range(4) d) GROUP BY i, greatest(0, least(63, f + d - 1))"""


def _resized_sql(name: str, n: int) -> str:
    return f"""{name}_taps AS ({_taps(n)}), {name}_rows AS (SELECT image, i AS y, p.x, sum(k * gray) AS v FROM pixels p JOIN {name}_taps t ON t.x = p.y GROUP BY image, i, p.x),
 {name}_cells AS (SELECT image, i AS x, p.y, greatest(0, least(255, floor(sum(k * v) + 0.5::DOUBLE + 1e-9::DOUBLE))) AS v FROM {name}_rows p JOIN {name}_taps t ON t.x = p.x GROUP BY image, i, p.y),
 {name} AS (SELECT image, CAST(sum(v) AS BIGINT) AS {name}_sum, CAST(sum(v * (x + 1)) AS BIGINT) AS {name}_by_x, CAST(sum(v * (y + 1)) AS BIGINT) AS {name}_by_y FROM {name}_cells GROUP BY image)"""


@query(f"WITH {_P}, {', '.join(_resized_sql(name, n) for name, n in _RESIZED.items())} SELECT * FROM {' JOIN '.join(_RESIZED).replace('JOIN large', 'JOIN large USING (image)')}")
def resampled_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture made smaller and larger: sums of its pixels, and of these by column and by row."""
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(n).alias("n")) for name, n in _RESIZED.items()]))
    whole = views.pictures(spark, sf_dir, colour=False).select("*", wanted.alias("to")).select("image", "width", "height", "gray", "to.*")
    made = resample.resampled(whole, F.struct(F.col("n").alias("width"), F.col("n").alias("height"))).withColumn("v", resample.sums("width", "gray"))
    return made.groupBy("image").agg(*[F.max(F.when(F.col("name") == name, F.col(f"v.{c}"))).alias(f"{name}_{c}") for name in _RESIZED for c in ("sum", "by_x", "by_y")])


_PARTS_OF = " UNION ALL ".join(f"SELECT image, {i} AS part, x, y, gray FROM pixels WHERE {where}" for i, where in enumerate(("y < 9", "y >= 55", "x < 9", "x >= 55", "x BETWEEN 9 AND 54 AND y BETWEEN 9 AND 54")))


@query(f"""WITH {_P}, parts AS ({_PARTS_OF}), flat AS (SELECT *, coalesce(lead(gray) OVER r, lag(gray) OVER r) - coalesce(lag(gray) OVER r, lead(gray) OVER r) AS slope, {_BESIDE.format("gray", "r")} + 2 * gray AS level FROM parts WINDOW r AS (PARTITION BY image, part, y ORDER BY x)),
 grad AS (SELECT image, part, sqrt(pow({_BESIDE.format("slope", "c")} + 2 * slope, 2) + pow(coalesce(lead(level) OVER c, lag(level) OVER c) - coalesce(lag(level) OVER c, lead(level) OVER c), 2)) AS m FROM flat WINDOW c AS (PARTITION BY image, part, x ORDER BY y)),
 rough AS (SELECT image, part, CASE WHEN var_pop(m) < 1e-9 THEN 0 ELSE var_pop(m) END AS v FROM grad GROUP BY image, part), ratio AS (SELECT image, avg(v) FILTER (part < 4) AS rim, max(v) FILTER (part = 4) AS mid FROM rough GROUP BY image)
 SELECT image, round(least(1e6, rim / (mid + 1e-10)), 4) AS texture_ratio, rim / (mid + 1e-10) > 1.8 AS textured FROM ratio""")
def texture_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture(_measured(spark, sf_dir, "kernels"), F.struct(F.round("m.texture_ratio", 4).alias("texture_ratio"), F.col("m.textured").alias("textured")))


@query()
def canny_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge pixels and what is beside them: hysteresis along edges has no SQL; tested on small pictures."""
    return _picture(_measured(spark, sf_dir, "kernels"), F.struct("m.edge_density", "m.halo_variance"))


@query()
def frame_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and quadrilaterals by contour, and the mask they come from: contours have no SQL; tested on made pictures."""
    return _picture(_measured(spark, sf_dir, "frames"), F.struct("m.frame", "m.frame_score", "m.quad", "m.quad_score", F.size("m.boxes").alias("n_boxes"), "m.edge_share"))


#: Runs of bright pixels, links between touching ones, and the smallest run that each reaches.
_BRIGHT_PARTS = """steps AS (SELECT image, x, y, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS grp FROM pixels WHERE gray >= 128),
 runs AS (SELECT image, y, min(x) AS x0, max(x) AS x1, y * 64 + min(x) AS id FROM steps GROUP BY image, y, grp),
 near AS (SELECT a.image, a.id AS a, b.id AS b FROM runs a JOIN runs b ON b.image = a.image AND b.y = a.y + 1 AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1),
 links AS (SELECT image, a, b FROM near UNION ALL SELECT image, b, a FROM near),
 reach AS (SELECT image, id, id AS r FROM runs UNION SELECT reach.image, links.b, reach.r FROM reach JOIN links ON links.image = reach.image AND links.a = reach.id WHERE reach.r < links.b),
 rooted AS (SELECT image, id, min(r) AS root FROM reach GROUP BY image, id),
 parts AS (SELECT image, root, CAST(sum(x1 - x0 + 1) AS BIGINT) AS n_pixels, min(x0) AS x, min(y) AS y, max(x1) - min(x0) + 1 AS width, max(y) - min(y) + 1 AS height FROM runs JOIN rooted USING (image, id) GROUP BY image, root)"""


@query(f"WITH RECURSIVE {_P}, {_BRIGHT_PARTS} SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY root) AS INT) AS part, n_pixels, x, y, width, height FROM parts")
def bright_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected bright parts of every picture, cut into four tiles, with their areas and boxes."""
    whole = views.pictures(spark, sf_dir, colour=False)
    rows = [[F.substring("gray", 64 * y + 1 + x, n) for y in range(top, top + high)] for x, n, top, high in ((0, 40, 0, 20), (40, 24, 0, 20), (0, 40, 20, 44), (40, 24, 20, 44))]
    places = [(0, 40, 0, 20), (40, 24, 0, 20), (0, 40, 20, 44), (40, 24, 20, 44)]
    tiles = F.array(*[F.struct(F.lit(x).alias("left"), F.lit(top).alias("top"), F.lit(n).alias("width"), F.lit(high).alias("height"), F.concat(*r).alias("gray")) for (x, n, top, high), r in zip(places, rows)])
    cut = whole.select("image", F.inline(tiles))
    return components.tile_components(cut, lambda g: g >= 128)


# --- pictures to verdicts ----------------------------------------------------------------------------------------


@query()
def border_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every border method on every picture, its confidence, flag, reason and tier."""
    return _rounded(scans.border_scan(views.pictures(spark, sf_dir, colour=False)))


@query()
def editing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editing score of every picture from its own features and model scores."""
    return _rounded(scans.editing_scan(views.scored_pictures(spark, sf_dir, colour=False)))


@query()
def unified_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered tests over one decoding of each picture, as long verdicts."""
    return scans.unified(views.scored_pictures(spark, sf_dir, colour=False), ["specifications", "borders", "watermarks", "editing", "text"])


@query()
def picture_routine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routine scan over pictures: where each is filed, from its own pixels."""
    return verdicts.memberships(unified_scan(spark, sf_dir), ["image"])


# --- reports -----------------------------------------------------------------------------------------------------

_O = views.OPS_SQL


@query(f"""WITH {_O} SELECT component, count(*) FILTER (is_error) AS n_errors, count(*) FILTER (NOT is_error) AS n_successes, CASE WHEN count(*) FILTER (is_error) > 10 THEN 'error' WHEN count(*) FILTER (is_error) > 0 THEN 'degraded' ELSE 'active' END AS state,
 count(*) FILTER (is_error) <= 10 AS healthy, arg_max(is_error, (ts, event_id)) AS last_is_error FROM ops GROUP BY component""")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health_summary(views.ops(spark, sf_dir))


@query(f"WITH {_O}, h AS (SELECT component, count(*) FILTER (is_error) AS e FROM ops GROUP BY component) SELECT count(*) FILTER (e <= 10) AS n_healthy, count(*) FILTER (e > 10) AS n_failed, sum(e) AS n_errors FROM h")
def health_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health_totals(health_summary(spark, sf_dir))


@query(f"WITH {_O} SELECT event_type, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms, round(max(duration_ms), 6) AS peak_ms, round(count(*) * 1000.0::DOUBLE / sum(duration_ms), 6) AS per_second FROM ops GROUP BY event_type")
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.performance_summary(views.ops(spark, sf_dir)))


@query(f"WITH {_O}, e AS (SELECT component, count(*) AS n FROM ops WHERE is_error GROUP BY component) SELECT coalesce(sum(n), 0) AS n_errors, count(*) AS n_components, arg_max(component, (n, -component)) AS most_common FROM e")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.error_summary(views.ops(spark, sf_dir))


@query(f"""WITH {_O}, r AS (SELECT component, event_id, row_number() OVER o AS nth, round(avg(duration_ms) OVER (PARTITION BY component ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS mean_so_far, count(*) OVER (PARTITION BY component) AS n FROM ops WINDOW o AS (PARTITION BY component ORDER BY ts, event_id))
 SELECT * FROM r WHERE nth % 10 = 0 OR nth = n""")
def progress_running_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.running_progress(views.ops(spark, sf_dir)))


@query(f"""WITH {_O}, r AS (SELECT component, event_id, row_number() OVER (PARTITION BY component ORDER BY ts, event_id) AS from_start, row_number() OVER (PARTITION BY component ORDER BY ts DESC, event_id DESC) AS from_end FROM ops)
 SELECT * FROM r WHERE from_start <= 5 OR from_end <= 5""")
def sample_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sample_ends(views.ops(spark, sf_dir), "component", ["ts", "event_id"]).select("component", "event_id", "from_start", "from_end")


@query(f"WITH {_O} SELECT component, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM ops GROUP BY component")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.last_by_name(views.ops(spark, sf_dir).select("component", "event_id", "event_type"), "component", "event_id")


@query(f"WITH {_O}, r AS (SELECT component, event_id, row_number() OVER (PARTITION BY component ORDER BY duration_ms DESC, event_id) AS rank FROM ops) SELECT * FROM r WHERE rank <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_k(views.ops(spark, sf_dir), "component", "duration_ms", "event_id").select("component", "event_id", "rank")


@query(f"""WITH p AS (SELECT {_HAS} AS has, {_WM} AS percent, CAST(n_chars AS DOUBLE) / 1000 AS seconds FROM documents) SELECT count(*) AS total, count(*) FILTER (has) AS n_marked, count(*) FILTER (NOT has) AS n_clean,
 count(*) FILTER (has IS NULL) AS n_errors, round(count(*) FILTER (has) * 100.0::DOUBLE / count(*), 6) AS marked_percent, round(count(*) FILTER (NOT has) * 100.0::DOUBLE / count(*), 6) AS clean_percent,
 round(avg(seconds), 6) AS mean_seconds, count(*) FILTER (has AND percent > 95) AS n_flagged FROM p""")
def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "documents").selectExpr(f"{_HAS} AS has", f"{_WM} AS percent", "CAST(n_chars AS DOUBLE) / 1000 AS seconds")
    return _rounded(reports.detection_report(p))


@query(f"""WITH {_O}, c AS (SELECT component, count(*) AS n, sum(duration_ms) AS spent FROM ops GROUP BY component)
 SELECT component, n, n * 200.0::DOUBLE AS estimated_ms, round((n * 200.0::DOUBLE - spent) * 100 / (n * 200.0::DOUBLE), 6) AS saved_percent, round(n * 200.0::DOUBLE / spent, 6) AS factor FROM c""")
def speed_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = views.ops(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("spent"))
    return _rounded(reports.speed_estimate(by, "n", "spent")).drop("spent")


@query(f"""{_MEMBERS} SELECT count(*) FILTER (category = 'invalid') AS n_listed, count(DISTINCT filename) FILTER (category = 'invalid') AS n_unique,
 CAST(floor(count(*) FILTER (category = 'valid') * 100.0::DOUBLE / count(DISTINCT filename)) AS BIGINT) AS valid_percent FROM members""")
def invalid_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.invalid_totals(routine_scan(spark, sf_dir))


from . import runs as _runs  # noqa: E402, F401  registers the queries over whole runs
