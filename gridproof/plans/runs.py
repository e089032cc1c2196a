"""Queries over whole runs: sizes, messages, findings, gated verdicts, summaries, predictions, progress; each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sizes, tiers
from ..operators import ocr, reports, scans, specs, summaries, verdicts
from ..operators.running import along
from ..sources import copies, images
from ..sources.tables import read_table
from . import views
from .catalog import _ED, _HAS, _NORM, _ROUND, _WM, KEY, ORACLE_SQL, _round, _rounded, _totals, query

_SIZE = ["doc_id", "CAST(doc_id * 37 % 4200 + 1 AS INT) AS w", "CAST(n_chars * 13 % 3100 + 1 AS INT) AS h", "CAST(doc_id % 5 AS INT) AS c"]


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").selectExpr(*_SIZE)


_SIZED_SQL = f"sized AS (SELECT {views.duck(_SIZE)} FROM documents)"


def _scaled(w: str, h: str, f: str) -> str:
    return f"[CAST(floor({w} * ({f})) AS INT), CAST(floor({h} * ({f})) AS INT)]"


def _longest(most: int, least: int | None = None) -> str:
    low = f" WHEN greatest(w, h) < {least} THEN {_scaled('w', 'h', f'{least}.0::DOUBLE / greatest(w, h)')}" if least else ""
    return f"CASE WHEN greatest(w, h) > {most} THEN {_scaled('w', 'h', f'{most}.0::DOUBLE / greatest(w, h)')}{low} ELSE [w, h] END"


@query(f"""WITH {_SIZED_SQL}, one AS (SELECT *, {_longest(2000, 800)} AS t, {_longest(1500)} AS b, {_longest(2000)} AS x FROM sized),
 two AS (SELECT *, CASE WHEN least(x[1], x[2]) < 32 THEN {_scaled("x[1]", "x[2]", "32.0::DOUBLE / least(x[1], x[2])")} ELSE x END AS hard,
 CASE WHEN w > 2048 OR h > 2048 THEN CASE WHEN w::DOUBLE / h > 1 THEN [2048, CAST(floor(2048.0::DOUBLE / (w::DOUBLE / h)) AS INT)] ELSE [CAST(floor(2048.0::DOUBLE * (w::DOUBLE / h)) AS INT), 2048] END ELSE [greatest(w, 224), greatest(h, 224)] END AS clip FROM one)
 SELECT doc_id, t[1] AS text_w, t[2] AS text_h, b[1] AS border_w, b[2] AS border_h, hard[1] AS hard_w, hard[2] AS hard_h, clip[1] AS clip_w, clip[2] AS clip_h FROM two""")
def resize_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    rules = {"text": sizes.for_text(w, h), "border": sizes.for_borders(w, h), "hard": sizes.for_hard_pictures(w, h), "clip": sizes.for_clip(w, h)}
    made = _sized(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in rules.items()])
    return made.select("doc_id", *[F.col(f"{n}.{side}").alias(f"{n}_{side[0]}") for n in rules for side in ("width", "height")])


@query(f"""WITH {_SIZED_SQL}, cut AS (SELECT *, CASE WHEN w > h * 20 THEN h * 20 ELSE w END AS cw, CASE WHEN h > w * 20 THEN w * 20 ELSE h END AS ch,
 greatest(CASE WHEN greatest(w, h) > 3000 THEN 3000.0::DOUBLE / greatest(w, h) ELSE 1 END, CASE WHEN least(w, h) < 20 THEN 20.0::DOUBLE / least(w, h) ELSE 0 END) AS f, CASE c WHEN 3 THEN 'none' WHEN 1 THEN 'gray to colour' WHEN 4 THEN 'drop alpha' END AS fix FROM sized),
 done AS (SELECT *, CAST(floor(cw * f) AS INT) AS fw, CAST(floor(ch * f) AS INT) AS fh FROM cut)
 SELECT doc_id, fix, fw AS width, fh AS height, CAST((w - cw) // 2 AS INT) AS crop_x, CAST((h - ch) // 2 AS INT) AS crop_y, fix IS NOT NULL AND least(fw, fh) >= 20 AND greatest(fw, fh) <= 3000 AS ok FROM done""")
def text_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select("doc_id", sizes.text_input(F.col("w"), F.col("h"), F.col("c")).alias("v")).select("doc_id", "v.*")


_SAID = "CASE doc_id % 9 WHEN 0 THEN 'CUDA out of memory' WHEN 1 THEN 'cannot identify image file' WHEN 2 THEN 'shm.DLL missing' WHEN 3 THEN 'Unidentified image, CUDA memory' WHEN 4 THEN 'failed with weights_only=True' WHEN 5 THEN 'could not restore data location' WHEN 6 THEN 'CUDA error' WHEN 7 THEN NULL ELSE 'odd' END"


@query(f"""WITH p AS (SELECT doc_id, lower({_SAID}) AS m FROM documents) SELECT doc_id,
 CASE WHEN m IS NULL THEN NULL WHEN m LIKE '%identif_ image%' OR m LIKE '%unidentified image%' THEN 'unsupported_format' WHEN m LIKE '%cuda%' AND m LIKE '%memory%' THEN 'gpu_memory' WHEN m LIKE '%dll%' THEN 'library' ELSE 'other' END AS watermark,
 CASE WHEN m IS NULL THEN NULL WHEN m LIKE '%weights$_only%' ESCAPE '$' THEN 'incompatible_weights' WHEN m LIKE '%restore data location%' THEN 'corrupt_weights' ELSE 'other' END AS model_load,
 CASE WHEN m IS NULL THEN NULL WHEN m LIKE '%dll%' THEN 'library' WHEN m LIKE '%cuda%' THEN 'no_gpu' ELSE 'other' END AS runtime FROM p""")
def detector_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_SAID} AS m")
    return p.select("doc_id", *[tiers.detector_error(F.col("m"), d).alias(d) for d in tiers.DETECTOR_ERRORS])


_LINE = "CASE doc_id % 8 WHEN 0 THEN 'Processing image 3, Score: 4' WHEN 1 THEN 'Quality: 5' WHEN 2 THEN 'Failed: no' WHEN 3 THEN 'Finished' WHEN 4 THEN 'No ccache found. x' WHEN 5 THEN 'INFO: Could not find files for it' WHEN 6 THEN NULL ELSE 'analyzing' END"


@query(f"""WITH p AS (SELECT doc_id, {_LINE} AS m FROM documents) SELECT doc_id, CASE WHEN m LIKE '%Processing image%' OR m LIKE '%Analyzing%' THEN 'step' WHEN m LIKE '%Score:%' OR m LIKE '%Quality:%' THEN 'result'
 WHEN m LIKE '%Invalid:%' OR m LIKE '%Failed:%' THEN 'failure' WHEN m LIKE '%Completed%' OR m LIKE '%Finished%' THEN 'done' END AS kind, NOT coalesce(m LIKE '%Could not find files for the given pattern%' OR m LIKE '%INFO: Could not find files%' OR m LIKE '%No ccache found%', false) AS shown FROM p""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_LINE} AS m")
    return p.select("doc_id", tiers.console_kind(F.col("m")).alias("kind"), tiers.shown_in_log(F.col("m")).alias("shown"))


_LOGITS = ["doc_id % 7", "doc_id % 5 + 1", "3"]


@query(f"""WITH p AS (SELECT doc_id, {", ".join(f"({x})::DOUBLE AS l{i}" for i, x in enumerate(_LOGITS))}, 'photo_of_a_long_named_place_' || doc_id || '.png' AS name FROM documents), e AS (SELECT *, greatest(l0, l1, l2) AS top FROM p)
 SELECT doc_id, {_ROUND.format("exp(l1 - top) / (exp(l0 - top) + exp(l1 - top) + exp(l2 - top))")} AS share, CAST(CASE WHEN l0 = top THEN 0 WHEN l1 = top THEN 1 ELSE 2 END AS INT) AS best,
 CASE WHEN length(name) > 32 THEN substring(name, 1, 29) || '...' ELSE name END AS short, CASE doc_id % 3 WHEN 0 THEN 'Basic Validation' WHEN 1 THEN 'Text' ELSE 'Water Marks' END AS title FROM e""")
def classes_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "documents").select("doc_id", F.array(*[F.expr(x).cast("double") for x in _LOGITS]).alias("l"), F.concat(F.lit("photo_of_a_long_named_place_"), "doc_id", F.lit(".png")).alias("name"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'basic_validation' WHEN 1 THEN 'text' ELSE 'water_marks' END").alias("test"))
    return p.select("doc_id", _round(F.get(tiers.softmax(F.col("l")), 1)).alias("share"), tiers.argmax(F.col("l")).alias("best"), tiers.cut_name(F.col("name"), 32, 29).alias("short"), tiers.title_case(F.col("test")).alias("title"))


_FIGURES = {"brisque": "brisque", "niqe": "niqe", "clipiqa": "clipiqa", "clipping": "clipping", "entropy": "entropy", "laplacian": "laplacian", "edges": "density", "frequencies": "ratio"}


@query(f"""WITH {_NORM}, f AS (SELECT p_partkey, unnest(list_filter([CASE WHEN brisque > 65 THEN {{'code': 'brisque: significant degradation', 'value': brisque}} WHEN brisque > 45 THEN {{'code': 'brisque: moderate issues', 'value': brisque}} WHEN brisque < 25 THEN {{'code': 'brisque: excellent', 'value': brisque}} END,
 CASE WHEN niqe > 10 THEN {{'code': 'niqe: poor naturalness', 'value': niqe}} WHEN niqe > 6 THEN {{'code': 'niqe: reduced naturalness', 'value': niqe}} WHEN niqe < 4 THEN {{'code': 'niqe: excellent', 'value': niqe}} END,
 CASE WHEN clipiqa > 0.7 THEN {{'code': 'clipiqa: high quality', 'value': clipiqa}} WHEN clipiqa < 0.4 THEN {{'code': 'clipiqa: poor quality', 'value': clipiqa}} END, CASE WHEN clipping > 2 THEN {{'code': 'clipping: tone mapping or exposure', 'value': clipping}} END,
 CASE WHEN entropy > 7.9 THEN {{'code': 'entropy: artificial enhancement', 'value': entropy}} WHEN entropy < 6.0 THEN {{'code': 'entropy: tone manipulation', 'value': entropy}} END,
 CASE WHEN laplacian > 3000 THEN {{'code': 'laplacian: artificial sharpening', 'value': laplacian}} WHEN laplacian < 50 THEN {{'code': 'laplacian: over-smoothing', 'value': laplacian}} END,
 CASE WHEN density > 0.2 THEN {{'code': 'edges: over-enhancement', 'value': density}} WHEN density < 0.03 THEN {{'code': 'edges: blur or smoothing', 'value': density}} END,
 CASE WHEN ratio > 0.25 THEN {{'code': 'frequencies: artificial enhancement', 'value': ratio}} WHEN ratio < 0.02 THEN {{'code': 'frequencies: over-smoothing', 'value': ratio}} END], lambda x: x IS NOT NULL)) AS x FROM total),
 s AS (SELECT p_partkey, concat_ws('; ', CASE WHEN brisque > 50 THEN 'brisque: unnatural quality' END, CASE WHEN niqe > 8 THEN 'niqe: degraded naturalness' END, CASE WHEN clipiqa < 0.5 THEN 'clipiqa: low perceptual quality' END, CASE WHEN clipping > 0.1 THEN 'clipping: overexposure or contrast' END,
 CASE WHEN entropy < 6 THEN 'entropy: tone mapping or grading' END, CASE WHEN density > 0.2 THEN 'edges: sharpening' END, CASE WHEN variance > 25 THEN 'frequencies: filtering or enhancement' END) AS signs FROM total)
 SELECT p_partkey, x.code AS code, round(x.value, 6) AS value, CASE WHEN signs = '' THEN 'general signs of editing' ELSE signs END AS insights FROM f JOIN s USING (p_partkey)
 UNION ALL SELECT p_partkey, 'overall: ' || CASE WHEN overall >= 75 THEN 'Heavy Editing Detected' WHEN overall >= 60 THEN 'Moderate Editing Detected' WHEN overall >= 40 THEN 'Light Editing Detected' ELSE 'Natural/Minimal Editing' END || ', high reliability', round(overall, 6), CASE WHEN signs = '' THEN 'general signs of editing' ELSE signs END FROM total JOIN s USING (p_partkey)""")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _totals(spark, sf_dir)
    listed = tiers.findings(*[F.col(c) for c in _FIGURES.values()], F.col("n"), F.col("overall"), tiers.editing_category(F.col("overall")), F.lit(None).cast("string"))
    signs = tiers.insights(*[F.col(c) for c in ("brisque", "niqe", "clipiqa", "clipping", "entropy", "density", "variance")])
    return _rounded(t.select("p_partkey", F.explode(listed).alias("x"), signs.alias("insights")).select("p_partkey", "x.*", "insights"))


# --- runs --------------------------------------------------------------------------------------------------------

_CODE = "CASE WHEN doc_id % 13 = 0 THEN 'file_not_found' WHEN doc_id % 29 = 0 THEN 'width_too_small' ELSE 'ok' END"
_TEXT = "CASE doc_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'manual' WHEN 2 THEN 'fail' ELSE 'pass' END"


def _run_verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The routine's verdicts with a text test as the fifth, where some detectors had errors; and basic validation."""
    docs = read_table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('doc_', CAST(doc_id AS STRING)) AS filename", f"{_CODE} AS code", f"{_TEXT} AS text")
    text = docs.select(*KEY, F.lit("text").alias("test"), F.lit(5).alias("test_ord"), F.col("text").alias("status"), F.lit(0.0).alias("score"))
    broken = F.when((F.col("test") == "watermark") & (F.col("doc_id") % 31 == 0), "error").otherwise(F.col("status"))
    return views.verdicts(spark, sf_dir).withColumn("status", broken).unionByName(text), docs.select(*KEY, "code")


_RUN = f"""{views.VERDICTS_SQL}, five AS (SELECT doc_id, filename, test, test_ord, CASE WHEN test = 'watermark' AND doc_id % 31 = 0 THEN 'error' ELSE status END AS status FROM verdicts
 UNION ALL SELECT doc_id, 'doc_' || doc_id, 'text', 5, {_TEXT} FROM documents), codes AS (SELECT doc_id, {_CODE} AS code FROM documents),
 settled AS (SELECT doc_id, filename, test, test_ord, CASE WHEN status = 'error' THEN CASE WHEN test = 'text' THEN 'pass' ELSE 'fail' END ELSE status END AS status FROM five JOIN codes USING (doc_id) WHERE code = 'ok'
 UNION ALL SELECT doc_id, 'doc_' || doc_id, 'basic_validation', 0, CASE WHEN code = 'ok' THEN 'pass' ELSE 'fail' END FROM codes)"""


def _mode_sql(mode: str) -> str:
    if mode == "sequential":
        return f"""SELECT doc_id, filename, '{mode}' AS mode, CASE WHEN min(test_ord) FILTER (status <> 'pass') IS NULL THEN 'valid' WHEN arg_min(status, test_ord) FILTER (status <> 'pass') = 'manual' THEN 'manual_review' ELSE 'invalid' END AS category,
 coalesce(arg_min(test, test_ord) FILTER (status <> 'pass'), '') AS tests FROM settled GROUP BY doc_id, filename"""
    manual = "status = 'manual'" + (" AND test <> 'quality'" if mode == "parallel_advisory" else "")
    return f"""SELECT doc_id, filename, '{mode}' AS mode, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'invalid' WHEN count(*) FILTER ({manual}) > 0 THEN 'manual_review' ELSE 'valid' END AS category,
 coalesce(CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN string_agg(test, ';' ORDER BY test_ord) FILTER (status = 'fail') ELSE string_agg(test, ';' ORDER BY test_ord) FILTER ({manual}) END, '') AS tests FROM settled GROUP BY doc_id, filename"""


@query(f"WITH {_RUN} {' UNION ALL '.join(_mode_sql(m) for m in verdicts.MODES)}")
def run_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, gate = _run_verdicts(spark, sf_dir)
    return reduce(DataFrame.unionByName, [verdicts.by_mode(rows, gate, KEY, m).withColumn("mode", F.lit(m)) for m in verdicts.MODES])


@query(f"""WITH {_RUN} SELECT doc_id, max(status) FILTER (test = 'quality') AS quality, max(status) FILTER (test = 'border') AS border FROM five WHERE test IN ('border', 'quality') GROUP BY doc_id""")
def custom_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of some steps by number, looked up by test."""
    rows, _ = _run_verdicts(spark, sf_dir)
    steps = verdicts.step_numbers("4, 2,4", views.STEPS)
    return verdicts.looked_up(verdicts.of_steps(rows, steps), steps, ["doc_id"])


@query("SELECT doc_id, array_to_string(list_sort(list_filter(['borders', 'editing', 'specifications', 'text', 'watermarks'], lambda t: t <> CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'editing' ELSE '' END)), ',') AS enabled, CASE doc_id % 3 WHEN 2 THEN 'borders,cache' ELSE 'borders,cache,' || CASE doc_id % 3 WHEN 0 THEN 'text' ELSE 'editing' END END AS components FROM documents")
def test_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.expr("CASE doc_id % 3 WHEN 0 THEN array('text') WHEN 1 THEN array('editing') ELSE array() END").cast("array<string>")
    enabled = F.array_sort(F.array_except(F.array(*[F.lit(t) for t in scans.REGISTRY]), off))
    used = F.array_sort(F.array_union(F.array(F.lit("borders"), F.lit("cache")), off))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(enabled, ",").alias("enabled"), F.array_join(used, ",").alias("components"))


@query(f"""WITH {views.ASSETS_SQL}, c(o, spec, w, h, mw, mh, dx, lo, hi, kinds, mode, mb) AS (VALUES {", ".join("(" + ", ".join("NULL" if v is None else str(v) if not isinstance(v, (str, list)) else "'" + v + "'" if isinstance(v, str) else str(v) for v in (r[0], f"{r[1]}_{r[2]}", *r[3:8], *r[9:])) + ")" for r in specs.CATALOGUE)}),
 x AS (SELECT doc_id, spec, concat_ws(',', CASE WHEN NOT list_contains(kinds, format) THEN 'format' END, CASE WHEN NOT (width = w AND height = h) THEN 'dimensions' END,
 CASE WHEN NOT (CASE WHEN dx IS NOT NULL THEN abs(dpi_x - dx) <= 5 AND abs(dpi_y - dx) <= 5 ELSE dpi_x BETWEEN lo AND hi AND dpi_y BETWEEN lo AND hi END) THEN 'dpi' END, CASE WHEN file_size_mb > mb THEN 'file_size' END,
 CASE WHEN NOT coalesce(CASE c.mode WHEN 'CMYK' THEN assets.mode = 'CMYK' WHEN 'RGB' THEN assets.mode IN ('RGB', 'RGBA') END, true) THEN 'color_mode' END) AS lacks FROM assets, c) SELECT * FROM x""")
def spec_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = specs.spec_failures({c: F.col(c) for c in specs.PROPERTIES})
    return views.assets(spark, sf_dir).select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.spec", F.array_join("x.reasons", ",").alias("lacks"))


# --- summaries ---------------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT {_ED} AS s FROM documents) SELECT count(*) AS total, count(*) - count(*) FILTER (s > 30) - count(*) FILTER (s BETWEEN 25 AND 30) AS n_valid, count(*) FILTER (s > 30) AS n_invalid, count(*) FILTER (s BETWEEN 25 AND 30) AS n_manual,
 count(*) FILTER (s >= 18 AND s < 25) AS n_light, count(*) FILTER (s IS NULL) AS n_unscored FROM p""")
def editing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.editing_summary(read_table(spark, sf_dir, "documents").selectExpr(f"{_ED} AS score"))


_KIND = "CASE doc_id % 4 WHEN 0 THEN 'Simple Border' WHEN 1 THEN 'Textured Frame' WHEN 2 THEN 'Frame Structure' ELSE 'No Border' END"


@query(f"""WITH {views.DETECTIONS_SQL}, p AS (SELECT {_KIND} AS label, s_simple AS c FROM detections) SELECT label, count(*) AS n, count(*) FILTER (c >= 0.58) AS n_invalid, count(*) FILTER (c >= 0.35 AND c < 0.58) AS n_manual, count(*) FILTER (c < 0.35) AS n_valid, count(*) FILTER (c >= 0.85) AS n_high FROM p GROUP BY label""")
def border_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.border_summary(views.detections(spark, sf_dir).selectExpr(f"{_KIND} AS label", "s_simple AS confidence"))


_RESULT = ["'doc_' || doc_id AS filename", "CASE doc_id % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'manual_review' WHEN 2 THEN 'borders' ELSE 'invalid' END AS category", "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'text: 3 found' WHEN 2 THEN 'unreadable' ELSE 'Failed checks: borders: wide; text: many' END AS reason"]


@query(f"""WITH r AS (SELECT {", ".join(_RESULT)} FROM documents), s AS (SELECT filename, CASE category WHEN 'valid' THEN 1 WHEN 'manual_review' THEN 3 ELSE 2 END AS section, CASE WHEN category IN ('borders', 'invalid') THEN
 ['x ' || filename || ': Failed checks:'] || CASE WHEN reason LIKE 'Failed checks: %' THEN ['   1] borders: wide', '   2] text: many'] ELSE ['   1] ' || reason] END WHEN category = 'valid' THEN ['+ ' || filename] ELSE ['? ' || filename || ': ' || reason] END AS lines FROM r)
 SELECT section, unnest(range(len(lines)))::INT AS nth, filename, unnest(lines) AS line FROM s""")
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.report_lines(read_table(spark, sf_dir, "documents").selectExpr("concat('doc_', CAST(doc_id AS STRING)) AS filename", *_RESULT[1:]))


@query(f"WITH r AS (SELECT {', '.join(_RESULT)} FROM documents) SELECT CASE WHEN category IN ('valid', 'manual_review') THEN category ELSE 'invalid' END AS category, count(*) AS n, min(filename) AS first, max(filename) AS last FROM r GROUP BY 1")
def files_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").selectExpr("concat('doc_', CAST(doc_id AS STRING)) AS filename", *_RESULT[1:])
    return rows.groupBy(summaries.known_category(F.col("category")).alias("category")).agg(F.count("*").alias("n"), F.min("filename").alias("first"), F.max("filename").alias("last"))


_FILED = "CASE WHEN l.toxic = 1 THEN 'manual_review' WHEN l.quality = 0 THEN 'invalid' WHEN l.quality = 1 THEN 'valid' ELSE d.source END"


@query(f"""WITH r AS (SELECT d.doc_id, d.lang, {_FILED} AS found FROM documents d LEFT JOIN labels l USING (doc_id)), c AS (SELECT doc_id, lang, CASE WHEN found IN ('valid', 'manual_review') THEN found ELSE 'invalid' END AS category FROM r)
 SELECT category, lang, doc_id, row_number() OVER (PARTITION BY category ORDER BY lang, doc_id) AS rank FROM c""")
def file_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of files of each category, in order of language and number; an unknown category is invalid."""
    docs, labels = read_table(spark, sf_dir, "documents").alias("d"), read_table(spark, sf_dir, "labels").alias("l")
    joined = docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left").select("d.doc_id", "d.lang", F.expr(_FILED).alias("found"))
    return summaries.listed(joined.withColumn("category", summaries.known_category(F.col("found"))), "category", ["lang", "doc_id"])


@query(f"""WITH p AS (SELECT doc_id, {_HAS} AS has FROM documents) SELECT CASE has WHEN true THEN 'marked' WHEN false THEN 'clean' END AS found, doc_id, row_number() OVER (PARTITION BY has ORDER BY doc_id) AS rank FROM p""")
def detection_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each class of the detection report: marked, clean and (null) errors."""
    p = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_HAS} AS has")
    return summaries.listed(p.withColumn("found", F.when(F.col("has"), "marked").when(~F.col("has"), "clean")), "found", ["doc_id"])


@query(f"""WITH {views.OPS_SQL}, h AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN value_of >= 20 END AS hit FROM (SELECT *, duration_ms AS value_of FROM ops))
 SELECT event_type, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms, round(max(duration_ms), 6) AS peak_ms, round(count(*) * 1000.0::DOUBLE / sum(duration_ms), 6) AS per_second, count(hit) AS n_lookups, count(*) FILTER (hit) AS hits,
 round(coalesce(count(*) FILTER (hit) * 100.0::DOUBLE / nullif(count(hit), 0), 0), 6) AS hit_rate FROM h GROUP BY GROUPING SETS ((event_type), ())""")
def performance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations and cache hits by kind of operation and in all, in one pass."""
    ops = views.ops(spark, sf_dir).withColumn("hit", F.when(F.col("event_type").isin("click", "view"), F.col("duration_ms") >= 20))
    return _rounded(reports.performance_report(ops))


@query(f"SELECT doc_id, {_ED} AS score FROM documents ORDER BY score DESC NULLS LAST, doc_id")
def editing_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.by_score(read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_ED} AS score"), "score", "doc_id")


@query(f"WITH {views.DETECTIONS_SQL} SELECT doc_id, round(s_frame, 3) AS shown FROM detections WHERE s_frame >= 0.35 AND s_frame < 0.58 ORDER BY shown DESC, doc_id")
def manual_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.manual_by_confidence(views.detections(spark, sf_dir), "s_frame", "doc_id").select("doc_id", "shown")


@query(f"""WITH p AS (SELECT doc_id AS path, {_HAS} AS has, {_WM} AS percent FROM documents WHERE doc_id % 4 <> 3) SELECT d.doc_id AS path, p.has, p.percent, CASE WHEN p.path IS NULL THEN 'no result' END AS error, b.item_id IS NOT NULL AS "exists"
 FROM documents d LEFT JOIN p ON p.path = d.doc_id LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) b ON b.item_id = d.doc_id UNION ALL SELECT item_id - 1000000, NULL, NULL, 'missing file', true FROM benchmark""")
def predictions_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined back to their paths, error rows for missing files, and whether each path is among the sources."""
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("path"))
    found = docs.where("doc_id % 4 <> 3").selectExpr("doc_id AS path", f"{_HAS} AS has", f"{_WM} AS percent")
    missing = items.select((F.col("path") - 1000000).alias("path"), F.lit("missing file").alias("error"))
    rows = summaries.with_errors(summaries.back_to_paths(docs.select(F.col("doc_id").alias("path")), found), missing)
    return summaries.without_source(rows, items.union(items.select(F.col("path") - 1000000)), "path")


@query("""SELECT folder, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT 'en' AS folder, n_chars FROM documents WHERE lang = 'en' UNION ALL SELECT 'all', n_chars FROM documents) GROUP BY folder""")
def folders_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return summaries.folders_together({"en": docs.where("lang = 'en'"), "all": docs}).groupBy("folder").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT count(*) AS n, count(*) * 100.0::DOUBLE / 20 AS utilisation, min(date_diff('second', date_trunc('second', ts), (SELECT date_trunc('second', max(ts)) FROM events))) AS newest_age, max(date_diff('second', date_trunc('second', ts), (SELECT date_trunc('second', max(ts)) FROM events))) AS oldest_age,
 count(*) FILTER (event_type <> 'error') AS hits, count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*) AS hit_rate FROM events""")
def cache_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = views.ops(spark, sf_dir)
    now = ops.agg(F.max("ts").alias("now"))  # one row
    stats = summaries.cache_stats(ops.crossJoin(F.broadcast(now)).select(F.col("ts").alias("at"), "now"), 20, F.col("now"))
    rate = summaries.hit_rate(ops.select((~F.col("is_error")).alias("hit"))).drop("n")
    return stats.crossJoin(F.broadcast(rate))  # one row each


@query(f"""WITH {views.OPS_SQL}, r AS (SELECT component, ts, event_id, row_number() OVER o AS nth, avg(duration_ms) OVER (PARTITION BY component ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m, count(*) OVER (PARTITION BY component) AS n FROM ops WINDOW o AS (PARTITION BY component ORDER BY ts, event_id))
 SELECT component, event_id, nth, round(m, 6) AS mean_so_far, n, round(m, 6) * (n - nth) AS "left" FROM r WHERE nth % greatest(1, n // 10) = 0 OR nth = n""")
def progress_with_time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = summaries.progress(views.ops(spark, sf_dir), "component", ["ts", "event_id"], "duration_ms").drop("ts")
    return p.withColumn("mean_so_far", F.round("mean_so_far", 6)).withColumn("left", F.col("mean_so_far") * (F.col("n") - F.col("nth")))


@query(f"""WITH {views.OPS_SQL}, r AS (SELECT ts, event_id, row_number() OVER o AS nth, avg(duration_ms) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m, count(*) OVER () AS n FROM ops WINDOW o AS (ORDER BY ts, event_id))
 SELECT event_id, nth, n, round(m, 6) AS mean_so_far, round(m, 6) * (n - nth) AS "left" FROM r WHERE nth % greatest(1, n // 10) = 0 OR nth = n""")
def progress_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run over all events, in one order: running figures by ranges, not in one task."""
    p = summaries.run_progress(views.ops(spark, sf_dir), ["ts", "event_id"], "duration_ms").drop("ts")
    return p.withColumn("mean_so_far", F.round("mean_so_far", 6)).withColumn("left", F.col("mean_so_far") * (F.col("n") - F.col("nth")))


_MICROS = "CAST(round(duration_ms * 1000) AS BIGINT)"


@query(f"""WITH {views.OPS_SQL} SELECT event_id, component, row_number() OVER o AS nth, CAST(sum({_MICROS}) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS took_so_far, CAST(sum(CAST(is_error AS INT)) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors_so_far
 FROM ops WINDOW o AS (ORDER BY ts, event_id)""")
def running_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its number in the run and what the run has taken and failed so far."""
    ops = views.ops(spark, sf_dir).selectExpr("ts", "event_id", "component", f"{_MICROS} AS took", "CAST(is_error AS BIGINT) AS failed")
    return along(ops, ["ts", "event_id"], {"took_so_far": "took", "errors_so_far": "failed"}).select("event_id", "component", "nth", "took_so_far", "errors_so_far")


@query("""WITH o AS (SELECT doc_id, concat('doc_', CAST(doc_id AS STRING)) AS path, row_number() OVER (ORDER BY concat('doc_', CAST(doc_id AS STRING)), doc_id) AS nth FROM documents) SELECT doc_id, path FROM o WHERE nth > 150 AND nth <= 550""")
def resumed_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that begins after 150 files of the listing and takes 400."""
    listed = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"))
    return images.slice_scan(listed, 150, 400)


_CORNERS = [("doc_id % 50", "doc_id % 30"), ("doc_id % 50 + 40", "doc_id % 30 + doc_id % 9"), ("doc_id % 50 + 38", "doc_id % 30 + 25"), ("doc_id % 50 - 2", "doc_id % 30 + 20")]


@query(f"""WITH p AS (SELECT doc_id, [{", ".join(x for x, _ in _CORNERS)}] AS xs, [{", ".join(y for _, y in _CORNERS)}] AS ys FROM documents) SELECT doc_id, list_min(xs) AS x, list_min(ys) AS y, list_max(xs) - list_min(xs) + 1 AS w, list_max(ys) - list_min(ys) + 1 AS h,
 round(degrees(atan2((ys[2] - ys[1])::DOUBLE, (xs[2] - xs[1])::DOUBLE)), 6) AS angle, least(3, doc_id % 5) AS n_zipped FROM p""")
def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and angles of text polygons, and parallel lists cut to the shortest."""
    polygon = F.array(*[F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in _CORNERS])
    p = read_table(spark, sf_dir, "documents").select("doc_id", polygon.alias("p"), F.slice(F.array(*[F.lit(i) for i in range(5)]), F.lit(1), (F.col("doc_id") % 5).cast("int")).alias("scores"))
    three = F.array(*[F.lit(t) for t in "abc"])
    return _rounded(p.select("doc_id", ocr.bounding_box(F.col("p")).alias("b"), ocr.angle(F.col("p")).alias("angle"), F.size(ocr.zipped(three, F.col("scores"), three)).cast("long").alias("n_zipped")).select("doc_id", "b.*", "angle", "n_zipped"))


@query(f"WITH {views.SCORES_SQL} SELECT p_partkey, clipiqa BETWEEN 0 AND 1 AND (clipiqa < 0.1 OR clipiqa > 0.9) AS suspicious, CASE WHEN clipiqa BETWEEN 0 AND 1 THEN clipiqa END AS valid FROM scores")
def raw_score_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("clipiqa")
    return views.scores(spark, sf_dir).select("p_partkey", tiers.suspicious_unit(x).alias("suspicious"), tiers.unit_score(x).alias("valid"))


@query("""WITH p AS (SELECT doc_id, 't' || doc_id % 40 || '.png' AS filename, CASE doc_id % 5 WHEN 0 THEN 'VALID_CLEAN' WHEN 1 THEN 'MANUAL_REVIEW' WHEN 2 THEN 'INVALID_WATERMARKED' WHEN 3 THEN NULL ELSE 'INVALID_WATERMARKED' END AS folder FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY folder, filename ORDER BY doc_id) - 1 AS n FROM p)
 SELECT doc_id, folder, CASE WHEN folder IS NULL THEN NULL WHEN n = 0 THEN folder || '/' || filename ELSE folder || '/' || split_part(filename, '.', 1) || '_' || n || '.png' END AS target FROM r""")
def text_copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies by the tier of found text; an error is copied nowhere, an unknown status goes with the failures."""
    status = "CASE doc_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'manual' WHEN 2 THEN 'fail' WHEN 3 THEN 'error' ELSE 'odd' END AS status"
    rows = read_table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('t', CAST(doc_id % 40 AS STRING), '.png') AS filename", status)
    return copies.copy_plan(rows, "text", path="doc_id").select("doc_id", "folder", "target")


@query("SELECT c_custkey, rpad(c_name, 20, ' ') || ' | ' || lpad(CAST(c_nationkey AS VARCHAR), 6, ' ') AS line FROM customer")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("nation"))
    return rows.select("c_custkey", summaries.table_line([("c_name", 20, "left"), ("nation", 6, "right")]).alias("line"))


#: Tests by their fallbacks: all that have one without a model.
_PLAIN = ("specifications", "borders", "editing")
_UNIFIED = f"""e AS ({ORACLE_SQL["edge_strips"]}), f AS ({ORACLE_SQL["fallback_editing"]}), p AS (SELECT vec_id AS image, CASE WHEN vec_id % 11 <> 0 THEN vec_id % 4 = 0 END AS has, (vec_id * 29 % 201) / 2.0::DOUBLE AS percent, vec_id % 8 AS n, (vec_id * 13 % 100)::DOUBLE AS conf FROM embeddings),
 plain AS (SELECT image, 'specifications' AS test, 1 AS test_ord, 'fail' AS status, 'too small' AS reason, 0.0::DOUBLE AS score FROM p
 UNION ALL SELECT image, 'borders', 2, CASE WHEN bordered THEN 'fail' ELSE 'pass' END, CASE WHEN bordered THEN 'even strips along the edges' ELSE 'no even strips' END, variance FROM e
 UNION ALL SELECT image, 'watermarks', 3, CASE WHEN has IS NULL THEN 'error' WHEN has AND percent > 96 THEN 'fail' WHEN has AND percent > 91 THEN 'manual' ELSE 'pass' END, CASE WHEN has IS NULL THEN 'no result' WHEN has THEN 'watermark' ELSE 'no watermark' END, percent FROM p
 UNION ALL SELECT image, 'editing', 4, CASE WHEN passed THEN 'pass' ELSE 'fail' END, CASE WHEN passed THEN 'histograms are natural' ELSE 'few tones or many peaks' END, score FROM f
 UNION ALL SELECT image, 'text', 5, CASE WHEN conf > 80 OR n > 5 THEN 'fail' WHEN conf > 60 OR n > 2 THEN 'manual' ELSE 'pass' END, n || ' texts', conf FROM p)"""


@query(f"WITH {_UNIFIED} SELECT image, 'picture_' || image || '.png' AS filename, test, test_ord, status, reason, round(score, 6) AS score FROM plain")
def unified_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tests over one decoding of each picture, where no model is at hand."""
    return _rounded(scans.unified(views.scored_pictures(spark, sf_dir), plain=_PLAIN))


@query(f"""WITH {_UNIFIED}, first AS (SELECT image, min(test_ord) FILTER (status = 'fail') AS o FROM plain GROUP BY image),
 filed AS (SELECT image, CASE WHEN status = 'fail' THEN 'invalid' ELSE 'manual_review' END AS category, test FROM plain JOIN first USING (image) WHERE test <> 'specifications' AND (status = 'fail' OR status = 'manual' AND (o2 IS NULL OR test_ord < o2)))
 SELECT * FROM filed UNION ALL SELECT image, 'valid', NULL FROM first WHERE image NOT IN (SELECT image FROM filed)""".replace("min(test_ord) FILTER (status = 'fail') AS o FROM", "min(test_ord) FILTER (status = 'fail' AND test <> 'specifications') AS o2 FROM"))
def routine_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routine scan over pictures by the plain tests, without specifications: from bytes to where each is filed."""
    rows = scans.unified(views.scored_pictures(spark, sf_dir), scans.selected(without=["specifications"]), plain=_PLAIN)
    return verdicts.memberships(rows, ["image"])
