"""Derived views over the driver's tables: the same expressions make the DataFrame and the SQL text.

The tables hold no images, so operators run on deterministic renditions of them (integer and CASE arithmetic only).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table


def _cases(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_K = "doc_id % 8"
ASSETS = [
    "doc_id",
    "concat('doc_', CAST(doc_id AS STRING)) AS filename",
    f"{_cases(_K, ['1920', '800', '2480', '2079', '2480', '2079', '2480', '640'])} AS width",
    f"{_cases(_K, ['705', '600', '3508', '2953', '3508', '2953', '3508', '480'])} AS height",
    f"""{_cases(_K, ["'JPEG'", "'JPEG'", "'PNG'", "'JPEG'", "'TIFF'", "'PDF'", "'PNG'", "'BMP'"])} AS format""",
    f"""{_cases(_K, ["'RGB'", "'RGB'", "'RGB'", "'RGBA'", "'CMYK'", "'CMYK'", "'RGB'", "'RGB'"])} AS mode""",
    f"CAST({_cases(_K, ['72', '72', '180', '150', '300', '304', '250', '72'])} AS DOUBLE) AS dpi_x",
    f"CAST({_cases(_K, ['72', '72', '180', '150', '300', '304', '250', '72'])} AS DOUBLE) AS dpi_y",
    "CAST(n_chars AS DOUBLE) / 4096 AS file_size_mb",
    "n_chars * 256 AS file_size",
]
SCORES = [
    "p_partkey",
    "CAST(p_size AS DOUBLE) * 2 AS brisque",
    "CAST(p_size AS DOUBLE) / 3 AS niqe",
    "CAST(p_partkey % 120 AS DOUBLE) / 100 AS clipiqa",
    "CAST(p_partkey % 37 AS DOUBLE) * 3 AS clipping",
    "CAST(p_partkey % 90 AS DOUBLE) / 10 AS entropy",
    "CAST(p_partkey % 50 AS DOUBLE) / 100 AS ks",
    "CAST(p_partkey % 251 AS DOUBLE) * 80 AS laplacian",
    "CAST(p_partkey % 43 AS DOUBLE) / 100 AS density",
    "CAST(p_partkey % 131 AS DOUBLE) * 90 AS high",
    "CAST(p_partkey % 29 AS DOUBLE) / 100 AS ratio",
    "CAST(p_partkey % 83 AS DOUBLE) / 8 AS variance",
]
OCR = [
    "conv_id AS image",
    "turn",
    "text",
    "CAST((conv_id * 31 + turn * 17) % 100 AS DOUBLE) / 100 AS confidence",
    "CAST((conv_id * 7 + turn * 3) % 100 AS DOUBLE) / 100 AS detection",
    "CAST((conv_id * 3 + turn * 5) % 100 AS DOUBLE) / 100 AS recognition",
    "CAST((conv_id * 13 + turn * 7) % 40 AS INT) AS w",
    "CAST((conv_id * 5 + turn * 11) % 30 AS INT) AS h",
]
#: Rows of noise beside the real ones, by turn. Fixed values.
OCR_NOISE = ["'aaa'", "'--'", "'aaaaaaa'", "'ab'", "'Sale'", "'...!'", "concat('aaa', chr(10))", "concat(chr(9), '-- ')"]
_NOISE_ROWS = [e if e != "text" else f"{_cases(f'turn % {len(OCR_NOISE)}', OCR_NOISE)} AS text" for e in OCR]
OPS = ["user_id AS component", "event_id", "event_type", "event_type = 'error' AS is_error", "value AS duration_ms", "ts"]
DETECTIONS = [
    "doc_id",
    "CAST(doc_id * 7 % 101 AS DOUBLE) / 100 AS s_obvious",
    "CAST(doc_id * 11 % 101 AS DOUBLE) / 100 AS s_simple",
    "CAST(doc_id * 13 % 101 AS DOUBLE) / 100 AS s_frame",
    "CAST(doc_id * 17 % 101 AS DOUBLE) / 100 AS s_texture",
    "CAST(doc_id * 19 % 60 AS DOUBLE) AS noise",
    "doc_id % 3 = 0 AS uniform",
    "doc_id % 5 = 0 AS artifacts",
    "CAST(doc_id * 23 % 101 AS DOUBLE) / 100 AS vignette",
]
#: Steps of the routine scan, in order. Fixed values.
STEPS = ["specifications", "border", "watermark", "quality"]

_SPEC_OK = "(width = 1920 AND height = 705 AND format = 'JPEG' OR width = 800 AND height = 600 AND format = 'JPEG' OR width = 2480 AND format = 'PNG' AND dpi_x BETWEEN 150 AND 200 AND file_size_mb <= 1 OR width = 2079 AND format = 'JPEG' AND dpi_x BETWEEN 150 AND 200 OR width IN (2480, 2079) AND mode = 'CMYK' AND dpi_x BETWEEN 295 AND 305)"
_EDIT = "CAST(doc_id * 37 % 101 AS DOUBLE) / 100 * 60"


def duck(expressions: list[str]) -> str:
    """A select list as DuckDB reads it."""
    return ", ".join(e.replace("AS STRING", "AS VARCHAR") for e in expressions)


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").selectExpr(*ASSETS)


ASSETS_SQL = f"assets AS (SELECT {duck(ASSETS)} FROM documents)"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, filename, test, test_ord, status, score): a row for each asset and step of the routine scan.

    The specification verdicts come from the catalogue join; border and watermark verdicts stand in for detectors.
    """
    from ..functions import tiers
    from ..operators.specs import spec_match

    a = assets(spark, sf_dir).select("doc_id", "filename", "width", "height", "format", "mode", "dpi_x", "dpi_y", "file_size_mb")
    spec = spec_match(a).select("doc_id", F.when(F.col("matched"), "pass").otherwise("fail").alias("specifications"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    score = F.expr(_EDIT)
    wide = (
        a.select("doc_id", "filename")
        .join(spec, "doc_id")
        .join(labels, "doc_id", "left")
        .select(
            "doc_id",
            "filename",
            "specifications",
            F.when(F.col("quality") == 0, "fail").otherwise("pass").alias("border"),
            F.when(F.col("toxic") == 1, "manual").otherwise("pass").alias("watermark"),
            tiers.editing_tier(score).alias("quality"),
            score.alias("editing"),
        )
    )
    steps = F.array(*[F.struct(F.lit(s).alias("test"), F.lit(i + 1).alias("test_ord"), F.col(s).alias("status"), (F.col("editing") if s == "quality" else F.lit(0.0)).alias("score")) for i, s in enumerate(STEPS)])
    return wide.select("doc_id", "filename", F.explode(steps).alias("v")).select("doc_id", "filename", "v.*")


VERDICTS_SQL = f"""{ASSETS_SQL},
wide AS (SELECT doc_id, filename, CASE WHEN {_SPEC_OK} THEN 'pass' ELSE 'fail' END AS s1,
  CASE WHEN l.quality = 0 THEN 'fail' ELSE 'pass' END AS s2, CASE WHEN l.toxic = 1 THEN 'manual' ELSE 'pass' END AS s3, {_EDIT} AS editing
  FROM assets LEFT JOIN labels l USING (doc_id)),
verdicts AS (
  SELECT doc_id, filename, 'specifications' AS test, 1 AS test_ord, s1 AS status, 0.0 AS score FROM wide
  UNION ALL SELECT doc_id, filename, 'border', 2, s2, 0.0 FROM wide
  UNION ALL SELECT doc_id, filename, 'watermark', 3, s3, 0.0 FROM wide
  UNION ALL SELECT doc_id, filename, 'quality', 4, CASE WHEN editing > 30 THEN 'fail' WHEN editing >= 25 THEN 'manual' ELSE 'pass' END, editing FROM wide)"""


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    noise = rows.selectExpr(*_NOISE_ROWS, "turn + 1000 AS nth")
    return rows.selectExpr(*OCR, "turn AS nth").unionByName(noise)


OCR_SQL = f"ocr AS (SELECT {duck(OCR)}, turn AS nth FROM conversations UNION ALL SELECT {duck(_NOISE_ROWS)}, turn + 1000 FROM conversations)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").selectExpr(*SCORES)


SCORES_SQL = f"scores AS (SELECT {duck(SCORES)} FROM part)"


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(*OPS)


OPS_SQL = f"ops AS (SELECT {duck(OPS)} FROM events)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").selectExpr(*DETECTIONS)


DETECTIONS_SQL = f"detections AS (SELECT {duck(DETECTIONS)} FROM documents)"


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, width, height, u): vectors as brightness in 0..1, from which a 64 by 64 picture is made by ``pixels``."""
    rows = read_table(spark, sf_dir, "embeddings")
    u = F.transform("embedding", lambda e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), e.cast("double") + 0.5)))
    return rows.select(F.col("vec_id").alias("image"), u.alias("u"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, x, y, gray 0..255): four classes by image: plain, framed, uniform surround, vignette."""
    axis = F.sequence(F.lit(0), F.lit(63))
    grid = gray(spark, sf_dir).select("image", "u", F.explode(axis).alias("x")).select("image", "u", "x", F.explode(axis).alias("y"))
    x, y, kind = F.col("x"), F.col("y"), F.col("image") % 4
    plain = F.floor(F.get("u", x) * F.get("u", y) * 255).cast("int")
    rim = F.least(x, y, 63 - x, 63 - y) < 5
    centre = x.between(16, 47) & y.between(16, 47)
    fade = F.greatest(F.lit(0), F.least(F.lit(255), F.expr("230 - ((2 * x - 63) * (2 * x - 63) + (2 * y - 63) * (2 * y - 63)) div 50"))).cast("int")
    value = F.when((kind == 1) & rim, 250).when((kind == 2) & ~centre, 200).when(kind == 3, fade).otherwise(plain)
    return grid.select("image", "x", "y", value.alias("gray"))


#: Pictures that are drawn at a time.
DRAWN = 256


def drawn(batches: Iterator[pa.RecordBatch], colour: bool) -> Iterator[pa.RecordBatch]:
    """Pictures of ``gray``'s vectors, DRAWN of them a batch at most: a batch of vectors would be two hundred times as large."""
    y, x = np.mgrid[:64, :64]
    rim, middle = np.minimum(np.minimum(x, y), np.minimum(63 - x, 63 - y)) < 5, (x >= 16) & (x <= 47) & (y >= 16) & (y <= 47)
    fade = np.clip(230 - ((2 * x - 63) ** 2 + (2 * y - 63) ** 2) // 50, 0, 255)
    schema = pa.schema([("image", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("gray", pa.binary()), *([("rgb", pa.binary())] if colour else [])])

    def one(image: int, u: list[float]) -> dict:
        v = np.array(u)[:64]
        gray = np.floor(v[None, :] * v[:, None] * 255).astype(np.int64)
        gray = [gray, np.where(rim, 250, gray), np.where(middle, gray, 200), fade][image % 4]
        made = {"image": image, "width": 64, "height": 64, "gray": gray.astype(np.uint8).tobytes()}
        return made | {"rgb": np.stack([gray, (gray * 3 + x) % 256, 255 - gray], -1).astype(np.uint8).tobytes()} if colour else made

    for batch in batches:
        for at in range(0, batch.num_rows, DRAWN):
            few = batch.slice(at, DRAWN)
            yield pa.RecordBatch.from_pylist([one(i, u) for i, u in zip(few["image"].to_pylist(), few["u"].to_pylist())], schema)


def pictures(spark: SparkSession, sf_dir: str, colour: bool = True) -> DataFrame:
    """(image, width, height, gray, and with ``colour`` rgb): the pictures of ``pixels`` and ``colours``, a row with its bytes for each."""
    # the vectors are far smaller than their pictures, and one file of them is one task: they are dealt out before they are drawn
    dealt = gray(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image")
    return dealt.mapInArrow(lambda batches: drawn(batches, colour), "image long, width int, height int, gray binary" + (", rgb binary" if colour else ""))


def scored_pictures(spark: SparkSession, sf_dir: str, colour: bool = True) -> DataFrame:
    """Pictures with what comes from elsewhere: file properties, model scores, text and watermark confidences."""
    k = F.col("image")
    return pictures(spark, sf_dir, colour).withColumns(
        {
            "filename": F.concat(F.lit("picture_"), k.cast("string"), F.lit(".png")),
            "format": F.lit("PNG"),
            "mode": F.lit("RGB"),
            "dpi_x": F.lit(72.0),
            "dpi_y": F.lit(72.0),
            "file_size_mb": F.lit(0.1),
            "brisque": F.when(k % 5 != 0, (k % 100).cast("double")),
            "niqe": F.when(k % 7 != 0, (k % 20).cast("double")),
            "clipiqa": F.when(k % 3 != 0, (k % 120) / 100),
            "has_watermark": F.when(k % 11 != 0, k % 4 == 0),
            "watermark_percent": (k * 29 % 201) / 2,
            "n_texts": k % 8,
            "text_confidence": (k * 13 % 100).cast("double"),
        }
    )


PIXELS_SQL = """gray AS (SELECT vec_id AS image, list_transform(embedding, lambda e: greatest(0.0::DOUBLE, least(1.0::DOUBLE, e::DOUBLE + 0.5))) AS u FROM embeddings),
axis AS (SELECT range::INT AS i FROM range(64)),
pixels AS (SELECT image, x.i AS x, y.i AS y, CASE
  WHEN image % 4 = 1 AND least(x.i, y.i, 63 - x.i, 63 - y.i) < 5 THEN 250
  WHEN image % 4 = 2 AND NOT (x.i BETWEEN 16 AND 47 AND y.i BETWEEN 16 AND 47) THEN 200
  WHEN image % 4 = 3 THEN greatest(0, least(255, 230 - ((2 * x.i - 63) * (2 * x.i - 63) + (2 * y.i - 63) * (2 * y.i - 63)) // 50))
  ELSE floor(u[x.i + 1] * u[y.i + 1] * 255)::INT END AS gray
  FROM gray, axis x, axis y)"""

#: Channels of the pictures in colour, from their gray.
CHANNELS = "gray AS r, (gray * 3 + x) % 256 AS g, 255 - gray AS b"
COLOURS_SQL = f"colours AS (SELECT image, x, y, {CHANNELS} FROM pixels)"


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, x, y, r, g, b) of the same pictures."""
    return pixels(spark, sf_dir).selectExpr("image", "x", "y", *CHANNELS.split(", "))


#: Sobel gradients of ``pixels``, edges mirrored.
GRADIENTS_SQL = """flat AS (SELECT image, x, y, gray, coalesce(lead(gray) OVER r, lag(gray) OVER r) - coalesce(lag(gray) OVER r, lead(gray) OVER r) AS slope,
 coalesce(lead(gray) OVER r, lag(gray) OVER r) + 2 * gray + coalesce(lag(gray) OVER r, lead(gray) OVER r) AS level FROM pixels WINDOW r AS (PARTITION BY image, y ORDER BY x)),
grad AS (SELECT image, x, y, gray, sqrt(pow(coalesce(lag(slope) OVER c, lead(slope) OVER c) + 2 * slope + coalesce(lead(slope) OVER c, lag(slope) OVER c), 2)
 + pow(coalesce(lead(level) OVER c, lag(level) OVER c) - coalesce(lag(level) OVER c, lead(level) OVER c), 2)) AS m FROM flat WINDOW c AS (PARTITION BY image, x ORDER BY y))"""
