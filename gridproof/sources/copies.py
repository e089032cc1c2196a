"""Filing assets by category: a plan of copies as a DataFrame, the copies themselves in tasks, and verdict tables.

A plan is made in Spark alone (which asset goes where, under which name). Copies are written beside their target and
moved there, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import along
from ..operators.specs import with_clash_names
from .tables import written

#: Folder of each status, by kind of check. Fixed values.
FOLDERS = {
    "category": {"valid": "valid", "manual_review": "manualreview", "invalid": "invalid"},
    "tier": {"pass": "valid", "manual": "manualreview", "fail": "invalid"},
    "text": {"pass": "VALID_CLEAN", "manual": "MANUAL_REVIEW", "fail": "INVALID_WATERMARKED"},
    "routine": {"valid": "Valid", "manual_review": "ManualReview", "invalid": "Invalid"},
}


def folder_of(status: Column, kind: str) -> Column:
    """The folder of a status; an unknown one goes with the invalid, a null one (an error) nowhere."""
    names = FOLDERS[kind]
    other = names.get("invalid", names.get("fail"))
    out = F.when(status.isNull() | (status == "error"), None)
    for s, folder in names.items():
        out = out.when(status == s, folder)
    return out.otherwise(other)


def copy_plan(assets: DataFrame, kind: str = "category", status: str = "status", path: str = "path", filename: str = "filename", clash: str = "suffix") -> DataFrame:
    """The rows of ``assets`` with ``folder`` and ``target`` (folder/name; null for what is not copied).

    ``clash`` says what happens where a folder gets a name twice: ``suffix`` adds ``_1``, ``_2``, ... in order of path;
    ``last`` lets the last by path have the name and gives the others no target.
    """
    filed = assets.withColumn("folder", folder_of(F.col(status), kind))
    if clash == "suffix":
        named = with_clash_names(filed, "folder", filename, path)
        return named.withColumn("target", F.when(F.col("folder").isNotNull(), F.concat_ws("/", "folder", "target")))
    last = filed.where("folder IS NOT NULL").groupBy("folder", filename).agg(F.max(path).alias("_last"))
    joined = filed.join(last, ["folder", filename], "left")
    return joined.withColumn("target", F.when(F.col(path) == F.col("_last"), F.concat_ws("/", "folder", filename))).select(*filed.columns, "target")


def local_path(path: str) -> str:
    """The path of a ``file:`` address; any other text as it is."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def copy_files(plan: DataFrame, root: str, path: str = "path") -> DataFrame:
    """(source, target, error) for each row of a plan with a target: carried out under ``root``, in a file system that all workers share.

    Lazy: an action on the result copies. A source that can't be read is a row with its error; all others are copied.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for source, target in zip(batch.source, batch.target):
                place = os.path.join(local_path(root), target)
                aside = f"{place}.{uuid.uuid4().hex}"
                try:
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    shutil.copy2(local_path(source), aside)
                    os.replace(aside, place)
                    errors.append(None)
                except OSError as e:
                    errors.append(f"{type(e).__name__}: {e.strerror}")
            yield batch.assign(error=pd.Series(errors, index=batch.index, dtype=object))

    wanted = plan.where("target IS NOT NULL").select(F.col(path).alias("source"), "target")
    return wanted.mapInPandas(run, "source string, target string, error string")


#: A clash suffix before the extension.
SUFFIX = r"^(.*)_(\d{1,9})(\.[^.]*)?$"


def names_there(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name) of the files under ``root`` in folders of one level: what a copy must not replace."""
    rows = [(f.name, n.name) for f in os.scandir(local_path(root)) if f.is_dir() and not f.name.startswith("_") for n in os.scandir(f.path)] if os.path.isdir(local_path(root)) else []
    return spark.createDataFrame(rows, "folder string, name string")


def names_beside(plan: DataFrame, there: DataFrame, path: str = "path", filename: str = "filename") -> DataFrame:
    """``plan`` (folder, filename) with ``target``: names that clash neither with each other nor with those that are ``there``.

    The first by path of a folder's equal names has the name itself, unless it is taken; the others have ``_1``, ``_2``, ...
    but for numbers that are taken, by a file that is there or by another name of the plan. A name that very many files
    have is numbered along ranges of the plan, not in one task. Rows without a folder have no target.
    """
    filed = plan.where("folder IS NOT NULL")
    ordered = along(filed, ["folder", filename, path], nth="_nth")
    groups = ordered.groupBy("folder", filename).agg(F.min("_nth").alias("_first"))
    used = there.select("folder", "name", F.lit(True).alias("file")).unionByName(groups.select("folder", F.col(filename).alias("name"), F.lit(False).alias("file")))
    whole = used.where("file").select("folder", "name", F.lit(0).alias("k"))
    suffixed = used.where(F.col("name").rlike(SUFFIX)).select("folder", F.concat(F.regexp_extract("name", SUFFIX, 1), F.regexp_extract("name", SUFFIX, 3)).alias("name"), F.regexp_extract("name", SUFFIX, 2).alias("digits"))
    plain = suffixed.where((F.col("digits") == F.col("digits").cast("int").cast("string")) & (F.col("digits") != "0")).select("folder", "name", F.col("digits").cast("int").alias("k"))
    taken = whole.unionByName(plain).groupBy("folder", F.col("name").alias(filename)).agg(F.array_sort(F.collect_set("k")).alias("_taken"))
    known = groups.join(taken, ["folder", filename], "left")
    i = F.col("_nth") - F.col("_first")
    below = F.size(F.filter(F.transform(F.coalesce("_taken", F.array().cast("array<int>")), lambda t, j: t - j), lambda x: x <= i))
    dot = F.col(filename).rlike(r"\.[^.]*$")
    stem, ext = F.when(dot, F.regexp_extract(filename, r"^(.*)(\.[^.]*)$", 1)).otherwise(F.col(filename)), F.regexp_extract(filename, r"(\.[^.]*)$", 1)
    name = F.when(i + below == 0, F.col(filename)).otherwise(F.concat(stem, F.lit("_"), (i + below).cast("string"), ext))
    named = ordered.join(known, ["folder", filename]).withColumn("target", F.concat_ws("/", "folder", name)).select(*plan.columns, "target")
    return named.unionByName(plan.where("folder IS NULL").withColumn("target", F.lit(None).cast("string")))


def copy_committed(plan: DataFrame, root: str, path: str = "path", filename: str = "filename", all_or_none: bool = True) -> DataFrame:
    """Carries out a plan (folder, filename, path) under ``root`` as a whole: (source, target, error), a written table.

    Targets are named beside what is there. Copies are made aside first, in tasks that may run twice; only when all are
    made are they moved to their names, in tasks again, where a move that was done already counts as done. A source that
    can't be read undoes the run and raises (``all_or_none``), or is a row with its error; a job that fails
    leaves no file. ``root`` and the sources are in a file system that all workers share.
    """
    spark, aside = plan.sparkSession, f"_copying-{uuid.uuid4().hex}"
    base = local_path(root)
    wanted = written(names_beside(plan, names_there(spark, root), path, filename).where("target IS NOT NULL").select(F.col(path).alias("source"), "target"), "copy-plan")

    def each(work):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                errors = []
                for source, target in zip(batch.source, batch.target):
                    try:
                        work(source, os.path.join(base, aside, target), os.path.join(base, target))
                        errors.append(None)
                    except OSError as e:
                        errors.append(f"{type(e).__name__}: {e.strerror}")
                yield batch[["source", "target"]].assign(error=pd.Series(errors, index=batch.index, dtype=object))

        return run

    def make(source: str, staged: str, place: str) -> None:
        os.makedirs(os.path.dirname(staged), exist_ok=True)
        own = f"{staged}.{uuid.uuid4().hex}"
        shutil.copy2(local_path(source), own)
        os.replace(own, staged)

    def move(source: str, staged: str, place: str) -> None:
        os.makedirs(os.path.dirname(place), exist_ok=True)
        if os.path.exists(staged) or not os.path.exists(place):  # else an earlier attempt has moved it
            os.replace(staged, place)

    try:
        made = written(wanted.mapInPandas(each(make), "source string, target string, error string"), "copies-made")
        bad = made.where("error IS NOT NULL")
        if all_or_none and (r := bad.first()) is not None:
            raise OSError(f"{r.source}: {r.error}")
        return written(made.where("error IS NULL").mapInPandas(each(move), "source string, target string, error string").unionByName(bad), "copies")
    finally:
        shutil.rmtree(os.path.join(base, aside), ignore_errors=True)


def write_by_status(rows: DataFrame, path: str, status: str = "status") -> None:
    """The table of verdicts, a folder for each status; statuses that are not in ``rows`` keep what they have."""
    rows.write.partitionBy(status).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
