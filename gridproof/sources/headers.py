"""A data source of image headers: a few kilobytes of each file, and only of files that are asked for.

``spark.dataSource.register(HeaderSource)``, then ``spark.read.format("image_headers").option("kind", "recursive").load(folder)``.
Files are listed when the read is planned and dealt to partitions by number; equality, IN and size filters on
``extension`` and ``length`` are taken before a file is opened (with spark.sql.python.filterPushdown.enabled). Paths are
local or mounted on every executor; ``images.image_properties`` reads any store that Spark reads, in whole files.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .copies import local_path
from .images import EXTENSIONS, header

SCHEMA = "path string, filename string, extension string, length long, format string, width int, height int, mode string, dpi_x double, dpi_y double, file_size_mb double, bytes_read long"
#: Bytes that are read first, and how many times as many where a header goes on; files of a partition.
FIRST, MORE, FILES = 4096, 4, 1000
SIZES = {GreaterThan: lambda n, v: n > v, GreaterThanOrEqual: lambda n, v: n >= v, LessThan: lambda n, v: n < v, LessThanOrEqual: lambda n, v: n <= v, EqualTo: lambda n, v: n == v}


def header_of(path: str, length: int) -> tuple[tuple, int]:
    """``images.header`` of a file and the bytes that were read for it: more are read while the header goes on beyond them."""
    size, content = FIRST, b""
    with open(path, "rb") as f:
        while True:
            content += f.read(size - len(content))
            found = header(content)
            settled = found[0] is not None and (found[0] != "PNG" or b"IDAT" in content)
            known = content[:8] == b"\x89PNG\r\n\x1a\n" or content[:2] == b"\xff\xd8" or content[:4] in (b"II*\0", b"MM\0*")
            if settled or not known or len(content) >= length or len(content) < size:
                return found, len(content)
            size *= MORE


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = local_path(options["path"])
        self.extensions = set(EXTENSIONS[options.get("kind", "recursive")])
        self.deep = options.get("recursive", "true" if options.get("kind", "recursive") == "recursive" else "false").lower() == "true"
        self.each = int(options.get("filesperpartition", FILES))  # Spark gives options in lower case
        self.tests: list = []

    def listed(self) -> Iterator[tuple[str, int]]:
        folders = [self.folder]
        while folders:
            with os.scandir(folders.pop()) as entries:
                for e in entries:
                    if e.is_dir():
                        if self.deep:
                            folders.append(e.path)
                    elif e.name.rpartition(".")[2].lower() in self.extensions and "." in e.name and all(test(e.stat().st_size, v) for test, v in self.tests):
                        yield e.path, e.stat().st_size

    def partitions(self) -> list[InputPartition]:
        files = sorted(self.listed())
        return [Files(files[i : i + self.each]) for i in range(0, len(files), self.each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, length in partition.files if partition else []:
            try:
                found, n = header_of(path, length)
            except OSError:  # gone or not readable since it was listed: a row with nulls, as for one that is no image
                found, n = (None,) * 6, 0
            name = os.path.basename(path)
            yield f"file:{path}", name, name.rpartition(".")[2].lower(), length, *found, length / 1048576, n


class FilteringReader(HeaderReader):
    """A reader that takes filters, where the session lets Python sources have them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("extension",):
                self.extensions &= {f.value} if isinstance(f, EqualTo) else set(f.value)
            elif type(f) in SIZES and f.attribute == ("length",):
                self.tests.append((SIZES[type(f)], f.value))
            else:
                yield f


class HeaderSource(DataSource):
    """Rows of SCHEMA for the images in a folder; options: path, kind (of EXTENSIONS), recursive, filesPerPartition, takesFilters."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteringReader if self.options.get("takesFilters") == "true" else HeaderReader)(dict(self.options))


def image_headers(spark: SparkSession, folder: str, kind: str = "recursive", **options: str) -> DataFrame:
    spark.dataSource.register(HeaderSource)
    takes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("image_headers").option("kind", kind).option("takesFilters", takes).options(**options).load(folder)
