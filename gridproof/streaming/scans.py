"""Streaming scans: new asset rows are validated as they arrive, once within the cache's time.

An extension: the batch operators are the reference behaviour, and the same functions run here on ``readStream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def asset_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def validated_once(assets: DataFrame, key: str = "path", at: str = "ts", ttl: str = "300 seconds") -> DataFrame:
    """Each asset once within ``ttl``: state is dropped with the watermark, as a cache entry is with its age."""
    return assets.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def health_by_window(ops: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Errors and operations of each component in tumbling windows; rows later than ``late`` are left out."""
    by = ops.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "component")
    return by.agg(F.count_if("is_error").alias("n_errors"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "component", "n_errors", "n")
