"""Where results go: JSON and text written by Spark, in parts, over what was there before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reports import last_by_name


def write_results(results: DataFrame, path: str, name: str = "filename", order: str = "nth") -> None:
    """JSON lines, one for each name: of rows with the same name the last by ``order`` stays. Earlier output goes."""
    last_by_name(results, name, order).write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Any report table as JSON lines; earlier output goes."""
    rows.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, line: str = "line", order: list[str] | None = None) -> None:
    """Text, a row a line, sorted across parts by ``order``; earlier output goes."""
    (lines.orderBy(*order) if order else lines).select(F.col(line)).write.mode("overwrite").text(path)


def write_flags(flagged: DataFrame, path: str, name: str = "filename") -> None:
    """Appends the names of flagged files to a list."""
    flagged.select(F.col(name)).write.mode("append").text(path)


def copy_log(lines: DataFrame, path: str, test: str, line: str = "value") -> None:
    """A test's log lines with the test's name before each."""
    lines.select(F.concat(F.lit(f"[{test}] "), F.col(line))).write.mode("overwrite").text(path)
