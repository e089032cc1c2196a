"""Best-fit packing by length patterns: non-negative least squares over few-document patterns, then best fit.

Only the histogram of piece lengths (at most ``size`` rows) comes to the driver. There, counts for the patterns of
two or three lengths that fill a sequence exactly are fitted to the histogram and rounded down; what is left is
packed by best fit, length after length from the longest, on counts and not on pieces. The plan is a table of
(length, first rank, first sequence, offset) runs; a piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slabs, written
from .tokens import chunk_table

END_ID = 2


def pieces(docs: DataFrame, tokenizer: str, drops_space: bool, size: int, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): ``nth`` counts a task's pieces of one length from 0."""
    tail = np.array([end_id], "<u4").tobytes()
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]

    def run(batches):
        table, task = chunk_table(tokenizer, drops_space), TaskContext.get().partitionId()
        met = np.zeros(size + 1, np.int64)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slabs(np.array([len(t or "") for t in texts]), 1_000_000):
                rows = []
                for d, ids in zip(doc_ids[a:b], table.encode(texts[a:b])):
                    ids += tail
                    n = len(ids) // 4
                    at, k = 0, 0
                    while at < n:
                        end = at + (n - at - 1) % size + 1  # the first piece takes what full ones leave
                        rows.append((d, k, at, end - at, zlib.crc32(ids[4 * at : 4 * end]), task, int(met[end - at])))
                        met[end - at] += 1
                        at, k = end, k + 1
                cols = list(zip(*rows)) or [()] * len(fields)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], fields)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths (0 for none) that sum to ``size`` exactly, from the lengths there are."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    a = lengths[lengths < size]
    rows = []
    for x in a:
        if have[size - x] and x >= size - x:
            rows.append(np.array([[x, size - x, 0]]))
        y = a[(a <= x) & (size - x - a >= 1)]
        z = size - x - y
        ok = (z <= y) & have[z]
        if ok.any():
            rows.append(np.column_stack([np.full(ok.sum(), x), y[ok], z[ok]]))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def fit_counts(pattern: np.ndarray, histogram: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative least squares: counts x that bring the lengths used near the histogram, by accelerated projected gradient."""
    n, used = len(histogram), pattern > 0
    flat = np.where(used, pattern, 0).ravel()

    def lengths(x):
        out = np.bincount(flat, weights=np.repeat(x, 3), minlength=n)
        out[0] = 0
        return out

    def back(r):
        return r[pattern].sum(1)

    x = np.ones(len(pattern))
    for _ in range(12):  # the largest eigenvalue, for the step
        y = back(lengths(x))
        norm = np.linalg.norm(y)
        x = y / norm
    step = 1 / (norm * 1.05)
    x = np.zeros(len(pattern))
    z, t = x, 1.0
    target = histogram.astype(np.float64).copy()
    target[0] = 0
    for _ in range(steps):
        new = np.maximum(z + step * back(target - lengths(z)), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: np.ndarray, size: int) -> np.ndarray:
    """Runs (length, rank, count, sequence, offset): the pieces of a length with ranks from ``rank`` go to consecutive sequences."""
    left, taken, runs, sequences = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64), [], 0
    open_: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free space: runs of sequences

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, taken[length], count, sequence, offset))
        taken[length] += count
        left[length] -= count

    if left[size]:
        put(size, int(left[size]), 0, 0)
        sequences = int(taken[size])
    pattern = patterns(np.flatnonzero(left), size)
    if len(pattern):
        counts = np.floor(fit_counts(pattern, left) + 1e-9).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            parts = [int(v) for v in pattern[k] if v]
            most = min([int(counts[k]), *(int(left[v]) // parts.count(v) for v in set(parts))])
            if counts[k] <= 0:
                break
            if most > 0:
                at = 0
                for v in parts:
                    put(v, most, sequences, at)
                    at += v
                sequences += most
    for length in range(size, 0, -1):
        while left[length]:
            free = next((f for f in range(length, size + 1) if open_[f]), None)
            if free is None:
                each = size // length  # new sequences hold as many as fit
                n = -(-int(left[length]) // each)
                first = sequences
                sequences += n
                for k in range(each):
                    if count := min(n, int(left[length])):
                        put(length, count, first, k * length)
                        full = count
                        if count < n:
                            open_[size - k * length].append((first + count, n - count))
                            n = count
                    else:
                        open_[size - k * length].append((first, n))
                        n = 0
                        break
                if n:
                    open_[size - each * length].append((first, n))
                continue
            first, n = open_[free].pop()
            count = min(n, int(left[length]))
            put(length, count, first, size - free)
            open_[free - length].append((first, count))
            if count < n:
                open_[free].append((first + count, n - count))
    return np.array(runs, np.int64).reshape(-1, 5)


def best_fit_pack(docs: DataFrame, tokenizer: str, drops_space: bool = False, size: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece's place; sequences are gapless from 0.

    A document of more than ``size`` ids (its end id counts) is cut into pieces, the first of which may be shorter. A
    null or empty text is its end id alone. What is broadcast is the plan: at most three runs for each pattern of lengths
    and a few for each length left, whatever the number of pieces; the ranks at which each task's pieces begin are
    joined to the pieces (a row for each task and length, ``size`` rows a task at most). Repeated rows are packed each; a null doc_id stays null; an empty table
    gives an empty result. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, drops_space, size), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = written(counts.select("task", "length", "n", F.coalesce(before, F.lit(0)).alias("base")), "piece-counts")
    histogram = np.zeros(size + 1, np.int64)
    for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    runs = plan(histogram, size)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    sent = spark.sparkContext.broadcast((runs, np.searchsorted(runs[:, 0], np.arange(size + 2))))

    def place(batches):
        table, edge = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.zeros(len(length), np.int64)
            for v in np.unique(length):
                here = length == v
                at[here] = edge[v] + np.searchsorted(table[edge[v] : edge[v + 1], 1], rank[here], "right") - 1
            got = {"sequence_id": table[at, 3] + rank - table[at, 1], "offset": table[at, 4]}
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names if c != "rank"] + [pa.array(got["sequence_id"]), pa.array(got["offset"])], [c for c in batch.schema.names if c != "rank"] + ["sequence_id", "offset"])

    ranked = cut.join(bases.select("task", "length", "base"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
