"""Image files as DataFrames: listings by extension, header properties, decoded gray pixels.

Listings read paths and lengths only (the ``binaryFile`` source prunes the content); decoding runs in Arrow batches of
few rows, since a row is megabytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import along

#: Extensions by kind of scan. Fixed values.
EXTENSIONS = {
    "master": ["jpg", "jpeg", "png", "bmp", "tif", "tiff"],
    "recursive": ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp"],
    "border": ["jpg", "jpeg", "png", "bmp", "tiff", "gif", "webp"],
    "quality": ["jpg", "jpeg", "png", "bmp", "tiff", "tif"],
}


def image_files(spark: SparkSession, folder: str, kind: str = "recursive", recursive: bool | None = None, non_empty: bool | None = None, any_case: bool = True) -> DataFrame:
    """(path, filename, extension, length), sorted by path for recursive scans; the extension in either case, or (``any_case``
    off) in lower or upper case throughout, as some scans list them.

    The border scan skips empty files, which the source does before it opens them.
    """
    deep = (kind == "recursive") if recursive is None else recursive
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(folder)
    written = F.regexp_extract("path", r"\.([^./]+)$", 1)
    fits = F.lower(written).isin(EXTENSIONS[kind]) & (F.lit(any_case) | (written == F.lower(written)) | (written == F.upper(written)))
    kept = files.where(fits).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.lower(written).alias("extension"), "length")
    kept = kept.where("length > 0") if (kind == "border" if non_empty is None else non_empty) else kept
    return kept.orderBy("path") if deep else kept


def slice_scan(files: DataFrame, start: int = 0, most: int | None = None, key: str = "path") -> DataFrame:
    """The files from the ``start``-th in order of path, ``most`` at most: resuming a scan. Ranges of paths are numbered in parallel."""
    nth = F.col("_nth")
    return along(files, [key], nth="_nth").where((nth > start) & (nth <= start + most if most is not None else F.lit(True))).drop("_nth")


def tiff_tags(content: bytes) -> dict[int, float] | None:
    """The numbers in the first directory of a TIFF file (or of the EXIF part of another); null where it is cut off."""
    order = "<" if content[:2] == b"II" else ">"
    tags: dict[int, float] = {}
    try:
        at = struct.unpack_from(f"{order}I", content, 4)[0]
        for k in range(struct.unpack_from(f"{order}H", content, at)[0]):
            tag, kind, n, value = struct.unpack_from(f"{order}HHII", content, at + 2 + 12 * k)
            place = at + 2 + 12 * k + 8
            if kind == 3 and n <= 2:
                value = struct.unpack_from(f"{order}H", content, place)[0]
            elif kind == 5:
                above, below = struct.unpack_from(f"{order}II", content, value)
                value = above / below if below else 0
            tags[tag] = value
    except struct.error:
        return None
    return tags


def tiff_resolution(content: bytes) -> tuple[float, float]:
    """Dots an inch; 72 where they are not given."""
    tags = tiff_tags(content) or {}
    unit = {3: 2.54}.get(tags.get(296, 2), 1.0)
    return (tags.get(282) or 72.0 / unit) * unit, (tags.get(283) or 72.0 / unit) * unit


def tiff_header(content: bytes) -> tuple:
    """As ``header``, of a TIFF file; nulls where it is cut off or has no size."""
    tags = tiff_tags(content)
    if tags is None or 256 not in tags or 257 not in tags:
        return (None,) * 6
    mode = {0: "L", 1: "L", 2: "RGBA" if tags.get(277, 1) == 4 else "RGB", 3: "P", 5: "CMYK"}.get(tags.get(262))
    return "TIFF", int(tags[256]), int(tags[257]), mode, *tiff_resolution(content)


def header(content: bytes) -> tuple:
    """(format, width, height, mode, dpi_x, dpi_y) from a file's first bytes; nulls for what is no known image."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 26:
        w, h = struct.unpack(">II", content[16:24])
        mode = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(content[25])
        at, dpi = 8, (72.0, 72.0)
        while at + 8 <= len(content):
            n, kind = struct.unpack(">I4s", content[at : at + 8])
            if kind == b"pHYs":
                x, y, unit = struct.unpack(">IIB", content[at + 8 : at + 17])
                dpi = (x * 0.0254, y * 0.0254) if unit == 1 else dpi
            if kind == b"IDAT":
                break
            at += n + 12
        return "PNG", w, h, mode, *dpi
    if content[:2] == b"\xff\xd8":
        at, dpi = 2, (72.0, 72.0)
        while at + 9 < len(content) and content[at] == 0xFF:
            kind, n = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if kind == 0xE0 and content[at + 4 : at + 9] == b"JFIF\0" and content[at + 11] in (1, 2):
                x, y = struct.unpack(">HH", content[at + 12 : at + 16])
                k = 1.0 if content[at + 11] == 1 else 2.54
                dpi = (x * k, y * k)
            if kind == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0" and dpi == (72.0, 72.0):
                dpi = tiff_resolution(content[at + 10 : at + 2 + n])
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return "JPEG", w, h, {1: "L", 3: "RGB", 4: "CMYK"}.get(content[at + 9]), *dpi
            at += n + 2
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return "BMP", w, abs(h), "RGB", 72.0, 72.0
    if content[:4] in (b"II*\0", b"MM\0*"):
        return tiff_header(content)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP" and len(content) >= 30:
        kind = content[12:16]
        if kind == b"VP8X":
            w, h = (int.from_bytes(content[k : k + 3], "little") + 1 for k in (24, 27))
            return "WEBP", w, h, "RGBA" if content[20] & 16 else "RGB", 72.0, 72.0
        if kind == b"VP8L":
            bits = int.from_bytes(content[21:25], "little")
            return "WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "RGBA" if bits >> 28 & 1 else "RGB", 72.0, 72.0
        if kind == b"VP8 ":
            w, h = struct.unpack("<HH", content[26:30])
            return "WEBP", w & 0x3FFF, h & 0x3FFF, "RGB", 72.0, 72.0
    if content[:4] in (b"GIF8",) and len(content) >= 10:
        return "GIF", *struct.unpack("<HH", content[6:10]), "P", 72.0, 72.0
    return None, None, None, None, None, None


def image_properties(files: DataFrame) -> DataFrame:
    """(path, format, width, height, mode, dpi_x, dpi_y, file_size_mb) of ``binaryFile`` rows; undecodable ones are rows with nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = pd.DataFrame([header(bytes(c)) if c is not None else (None,) * 6 for c in batch.content], columns=["format", "width", "height", "mode", "dpi_x", "dpi_y"], index=batch.index)
            got["width"], got["height"] = got.width.astype("Int32"), got.height.astype("Int32")
            yield pd.concat([batch[["path"]], got, (batch.length / 1048576).rename("file_size_mb")], axis=1)

    schema = "path string, format string, width int, height int, mode string, dpi_x double, dpi_y double, file_size_mb double"
    return files.select("path", "length", "content").mapInPandas(run, schema)


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data, ok): rows of the image source; a file that can't be decoded has ok = false."""
    rows = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), (F.col("image.width") > 0).alias("ok"))


def gray_of(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Gray levels 0..255 from row-major BGR(A) bytes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return a[:, :, 0] if channels == 1 else np.rint(a[:, :, 0] * 0.114 + a[:, :, 1] * 0.587 + a[:, :, 2] * 0.299)


def rgb_of(data: bytes, width: int, height: int, channels: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The three colours and, where there is one, the alpha of row-major BGR(A) bytes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return (np.repeat(a, 3, axis=2), None) if channels == 1 else (a[:, :, 2::-1], a[:, :, 3] if channels == 4 else None)


def pictures(images: DataFrame) -> DataFrame:
    """(image, filename, width, height, gray, rgb, alpha) of ``decoded`` rows, decoded once for all tests: bytes row by row.

    A file that can't be decoded stays as a row without bytes, so that every test reports it as an error.
    """
    fields = [("gray", pa.binary()), ("rgb", pa.binary()), ("alpha", pa.binary())]

    def split(width: pa.Array, height: pa.Array, channels: pa.Array, data: pa.Array) -> pa.Array:
        rows = []
        for w, h, c, d in zip(*(x.to_pylist() for x in (width, height, channels, data))):
            if d is None or not w or w < 1 or len(d) != w * h * c:
                rows.append(None)
                continue
            rgb, alpha = rgb_of(d, w, h, c)
            rows.append({"gray": gray_of(d, w, h, c).astype(np.uint8).tobytes(), "rgb": rgb.tobytes(), "alpha": None if alpha is None else alpha.tobytes()})
        return pa.array(rows, type=pa.struct(fields))

    made = F.arrow_udf(split, "struct<gray: binary, rgb: binary, alpha: binary>").asNondeterministic()
    named = images.withColumns({"_bytes": made("width", "height", "channels", "data"), "filename": F.regexp_extract("path", r"([^/]+)$", 1)})
    return named.select(F.col("path").alias("image"), "filename", "width", "height", "_bytes.*")


def pixel_table(images: DataFrame) -> DataFrame:
    """(image, x, y, gray) of decoded images, one row a pixel, for the grouped features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                g = gray_of(bytes(r.data), r.width, r.height, r.channels).astype(np.int32)
                y, x = np.mgrid[: r.height, : r.width].astype(np.int32)
                yield pd.DataFrame({"image": r.path, "x": x.ravel(), "y": y.ravel(), "gray": g.ravel()})

    return images.where("ok").select("path", "width", "height", "channels", "data").mapInPandas(run, "image string, x int, y int, gray int")


def resume_point(files: DataFrame) -> DataFrame:
    """Files with their place in order of path within their folder."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    return files.withColumn("nth", F.row_number().over(Window.partitionBy(folder).orderBy("path")))


def png_bytes(gray: np.ndarray) -> bytes:
    """A gray PNG, for fixtures."""
    h, w = gray.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes(r) for r in gray.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
