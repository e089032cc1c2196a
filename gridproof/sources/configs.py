"""Settings as dataclasses that are read from JSON, checked, and put into column expressions by the caller.

A file is read through Spark, so its path may be a remote one. Unknown keys are dropped; settings that contradict each
other, or a file that can't be read or parsed, give the defaults.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any, TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


@dataclass
class BorderSettings:
    """Of the border checks."""

    color_diff_threshold: float = 30.0
    confidence_threshold_low: float = 0.35
    confidence_threshold_manual: float = 0.55
    confidence_threshold_invalid: float = 0.58
    confidence_threshold_obvious: float = 0.85
    min_border_size_ratio: float = 0.005
    max_border_size_ratio: float = 0.15
    perimeter_focus_width: float = 0.15
    texture_sensitivity: float = 1.8
    apply_gaussian_blur: bool = False
    use_bilateral_filter: bool = False
    skip_preprocessing: bool = True

    def faults(self) -> list[str]:
        rising = [self.confidence_threshold_low, self.confidence_threshold_manual, self.confidence_threshold_invalid, self.confidence_threshold_obvious]
        out = [] if all(a < b for a, b in zip(rising, rising[1:])) else ["confidence thresholds must rise from low to obvious"]
        if self.min_border_size_ratio >= self.max_border_size_ratio:
            out.append("the least border ratio must be below the largest")
        if self.apply_gaussian_blur and self.use_bilateral_filter:
            out.append("only one kind of preprocessing can be used")
        return out


@dataclass
class SystemSettings:
    """Of a validation run."""

    processing_mode: str = "parallel"
    text_confidence_thresholds: dict = field(default_factory=lambda: {"high": 80.0, "medium": 60.0})
    text_count_thresholds: dict = field(default_factory=lambda: {"high": 5, "medium": 2})
    editing_thresholds: dict = field(default_factory=lambda: {"invalid": 30.0, "manual_review": 25.0})
    cache_size: int = 1
    min_image_width: int = 100
    min_image_height: int = 100
    min_file_size: int = 100
    max_file_size_mb: int = 50
    max_cache_size: int = 1
    cache_ttl_seconds: int = 300

    def faults(self) -> list[str]:
        out = [] if self.processing_mode in ("sequential", "parallel") else ["unknown processing mode"]
        for name in ("text_confidence_thresholds", "editing_thresholds"):
            out += [f"{name}.{k} must be a number of 0 or more" for k, v in getattr(self, name).items() if not _number(v) or v < 0]
        out += [f"text_count_thresholds.{k} must be a whole number of 0 or more" for k, v in self.text_count_thresholds.items() if not isinstance(v, int) or v < 0]
        least_one = ("cache_size", "min_image_width", "min_image_height", "min_file_size", "max_file_size_mb", "max_cache_size", "cache_ttl_seconds")
        return out + [f"{name} must be 1 or more" for name in least_one if not _number(getattr(self, name)) or getattr(self, name) < 1]


@dataclass
class DetectorSettings:
    """Of the detectors whose scores a run reads."""

    watermark_confidence_threshold: float = 96.0
    watermark_review_threshold: float = 91.0
    editing_confidence_threshold: float = 25.0
    ocr_max_dimension: int = 2000
    border_max_dimension: int = 1500
    max_retry_attempts: int = 2

    def faults(self) -> list[str]:
        return [f"{f.name} must be a number of 0 or more" for f in fields(self) if not _number(getattr(self, f.name)) or getattr(self, f.name) < 0]


Settings = TypeVar("Settings", BorderSettings, SystemSettings, DetectorSettings)


def settings_of(kind: type[Settings], given: dict[str, Any]) -> Settings:
    """Known keys of ``given`` (in either case) over the defaults; the defaults alone where the result is faulty."""
    known = {f.name for f in fields(kind)}
    low = {str(k).lower(): v for k, v in given.items()}
    try:
        made = kind(**{k: v for k, v in low.items() if k in known})
        return kind() if made.faults() else made
    except (TypeError, AttributeError):
        return kind()


def read_settings(spark: SparkSession, path: str, kind: type[Settings]) -> Settings:
    try:
        row = spark.read.text(path, wholetext=True).first()
        given = json.loads(row[0]) if row else {}
    except (PySparkException, ValueError):
        return kind()
    return settings_of(kind, given) if isinstance(given, dict) else kind()


def write_settings(spark: SparkSession, settings: BorderSettings | SystemSettings | DetectorSettings, path: str) -> None:
    """As a folder with one JSON text, which ``read_settings`` reads."""
    spark.createDataFrame([(json.dumps(asdict(settings)),)], "value string").coalesce(1).write.mode("overwrite").text(path)
