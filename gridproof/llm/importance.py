"""Importance resampling towards a target corpus, by bucket-partitioned inverted postings.

Features (runs of one to three words) are hashed to buckets. Each task turns blocks of documents into postings: for each
range of buckets, which (bucket, document) pairs of the block occur and how often, packed as differences in byte planes.
Postings are shuffled by range of buckets to where both corpora's totals of these buckets come too; there the buckets'
gains are computed and, block by block, what the range adds to each document. These contributions, one array for each
block and range, are shuffled by block and added up by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import along
from .common import pieces_of, spaced_out, written

BUCKETS = 10_000
#: Ranges of buckets that are dealt out, each with the same number of buckets.
RANGES = 64
#: A block of documents ends at so many documents or features; postings of so many blocks meet in one piece of a range.
BLOCK_DOCS, BLOCK_FEATURES, SLICE = 1024, 1_000_000, 256
#: A text is taken apart in pieces of so many bytes.
PIECE = 1 << 20
EDGES = np.array([-(-BUCKETS * r // RANGES) for r in range(RANGES + 1)], np.int64)

SPLIT = "kind int, range int, block long, n int, postings binary, counts binary, totals array<long>, doc_ids array<long>, n_features array<long>, n_words array<long>"
POSTINGS, TOTALS, DOCS = range(3)


def feature_buckets(raw: bytes) -> tuple[list[np.ndarray], int]:
    """The bucket of every feature of a text, in pieces, and the number of words."""
    found, words, n_words = [], [], 0
    for part in spaced_out(raw, PIECE):
        kept = words[-2:]  # features may begin in the piece before
        words, c = kept + part, len(kept)
        n_words += len(part)
        spaced = [b" " + w for w in words]
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        codes = one[c:] + two[max(c - 1, 0) :] + three
        found.append((np.array(codes, np.uint32) % np.uint32(BUCKETS)).astype(np.int32))
    return found, n_words


def planes(values: np.ndarray) -> bytes:
    """Numbers under 2**32: how many bytes the largest needs, then all low bytes, all second ones and so on."""
    k = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([k]) + values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :k].T.tobytes()


def numbers(planed: bytes) -> np.ndarray:
    k = planed[0]
    out = np.zeros(((len(planed) - 1) // k, 4), np.uint8)
    out[:, :k] = np.frombuffer(planed, np.uint8, offset=1).reshape(k, -1).T
    return out.view("<u4").ravel().astype(np.int64)


class Blocks:
    """Documents gathered to blocks; ``rows`` are those of SPLIT."""

    def __init__(self, first: int):
        self.next, self.totals, self.rows = first, np.zeros(BUCKETS, np.int64), []
        self.clear()

    def clear(self) -> None:
        self.docs, self.found, self.size = [], [], 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        parts, n_words = feature_buckets(raw)
        n = sum(map(len, parts))
        if len(parts) > 1:  # a long text: one count for each bucket
            counts = sum(np.bincount(p, minlength=BUCKETS) for p in parts)
            self.close()
            self.docs.append((doc_id, n, n_words))
            self.totals += counts
            self.put(np.flatnonzero(counts), counts[counts > 0])
            return
        self.docs.append((doc_id, n, n_words))
        self.found.append(parts[0] if parts else np.zeros(0, np.int32))
        self.size += n
        if self.size >= BLOCK_FEATURES or len(self.docs) >= BLOCK_DOCS:
            self.close()

    def close(self) -> None:
        if self.docs:
            nd = len(self.docs)
            keys = np.concatenate(self.found) * np.int32(nd)  # 32 bits hold BUCKETS * BLOCK_DOCS
            keys += np.repeat(np.arange(nd, dtype=np.int32), [len(x) for x in self.found])
            keys.sort()
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
            keys, counts = keys[edge[:-1]], np.diff(edge)
            self.totals += np.bincount(keys // nd, counts, BUCKETS).astype(np.int64)
            self.put(keys, counts)

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """A row of postings for each range of buckets, and one for the documents."""
        nd = len(self.docs)
        cut = np.searchsorted(keys, EDGES * nd)
        for r in np.flatnonzero(np.diff(cut)):
            a, b = cut[r], cut[r + 1]
            steps = np.diff(keys[a:b], prepend=keys.dtype.type(EDGES[r] * nd))
            self.rows.append((POSTINGS, int(r), self.next, nd, planes(steps), planes(counts[a:b]), None, None, None, None))
        self.rows.append((DOCS, None, self.next, nd, None, None, None, *[list(x) for x in zip(*self.docs)]))
        self.next += 1
        self.clear()

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 4]
    names = [c.split()[0] for c in SPLIT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=names)


def split_postings(docs: DataFrame, target: bool = False) -> DataFrame:
    """Rows of SPLIT for (doc_id, text): postings by block and range, a task's totals by bucket, the documents by block. Of a target only totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                blocks.add(doc_id, raw.as_py() or b"")
                if blocks.rows and not target:
                    yield _batch(blocks.taken())
                blocks.taken()
        blocks.close()
        rows = [] if target else blocks.taken()
        yield _batch([*rows, (TOTALS, None, None, None, None, None, blocks.totals.tolist(), None, None, None)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SPLIT)


def gains(s: list[int], t: list[int], all_s: int, all_t: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    return np.array([math.floor(1000 * math.log(float(y + 1) * float(all_s + BUCKETS) / (float(x + 1) * float(all_t + BUCKETS)))) for x, y in zip(s, t)], np.int64)


def contributions(split: DataFrame, target: DataFrame) -> DataFrame:
    """(block, sums): what each range of buckets adds to the weight of each document of a block.

    A range's postings are cut into slices of SLICE blocks, and its totals go to each slice: no task holds more than
    the postings of one block at a time.
    """
    n = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def summed(rows: DataFrame, name: str) -> DataFrame:
        each = rows.where(F.col("kind") == TOTALS).select(F.posexplode("totals").alias("bucket", "x"))
        return each.groupBy("bucket").agg(F.sum("x").alias(name))  # a row for each bucket

    both = summed(split, "s").join(summed(target, "t"), "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"))
    all_s, all_t = (int(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    slices = max(1, -(-(split.where(F.col("kind") == DOCS).count()) // SLICE))
    range_of = F.floor(F.col("bucket") * RANGES / BUCKETS).cast("int")
    totals = both.groupBy(range_of.alias("range")).agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("of"))  # BUCKETS / RANGES in each
    totals = totals.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("range", "slice", F.col("of.s").alias("s"), F.col("of.t").alias("t"))
    postings = split.where(F.col("kind") == POSTINGS).select("range", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), "block", "n", "postings", "counts")
    met = totals.unionByName(postings, allowMissingColumns=True).repartition(n, "range", "slice").sortWithinPartitions("range", "slice", F.col("block").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros(0, np.int64)
        for batch in batches:
            blocks, sums = [], []
            cols = [batch.column(c) for c in ("range", "block", "n", "postings", "counts", "s", "t")]
            for r, block, nd, steps, counts, s, t in zip(*cols):
                if not block.is_valid:  # the totals of a range come first
                    gain = gains(s.as_py(), t.as_py(), all_s, all_t)
                    continue
                nd = nd.as_py()
                keys = np.cumsum(numbers(steps.as_py()))
                got = np.zeros(nd, np.int64)
                np.add.at(got, keys % nd, gain[keys // nd] * numbers(counts.as_py()))
                blocks.append(block.as_py())
                sums.append(got)
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["block", "sums"])

    return met.select("range", "block", "n", "postings", "counts", "s", "t").mapInArrow(run, "block long, sums array<long>")


def weighed(split: DataFrame, added: DataFrame) -> DataFrame:
    """(block, place, doc_id, n_features, n_words, weight) of every document: its block's contributions added up."""
    n = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = split.where(F.col("kind") == DOCS).select("block", "doc_ids", "n_features", "n_words")
    met = docs.unionByName(added, allowMissingColumns=True).repartition(n, "block").sortWithinPartitions("block")
    out = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, "block"):
            blocks, sums = part["block"].to_numpy(), part["sums"].combine_chunks()
            edge = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]]))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                ids, features, words = (part[c].combine_chunks().slice(a, b - a).flatten() for c in ("doc_ids", "n_features", "n_words"))
                flat = sums.slice(a, b - a).flatten().to_numpy().reshape(-1, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), blocks[a])), pa.array(np.arange(len(ids), dtype=np.int32)), ids, features, words, pa.array(flat.sum(0))], schema=out)

    return met.mapInArrow(run, "block long, place int, doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) for a u in (0, 1) that the seed and the id decide: Gumbel noise in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Of the N rows with at least ``min_words`` words the floor(percent N / 100) highest scores are drawn, ties to the
    smaller doc_id, and ranked from 1; the others have a null rank. A null or empty text, or one without words, has no
    features and a weight of 0. Rows are documents each, repeated ones too: equal rows take ranks one after another. A
    null doc_id has the noise of an empty id and comes after others of its score. Empty ``docs`` give an empty result; an
    empty ``target`` has totals of 0. Other columns are neither read nor returned.
    """
    split = written(split_postings(docs), "postings")
    aimed = written(split_postings(target.select(F.lit(0).alias("doc_id"), "text"), target=True), "target")
    added = contributions(split, aimed)
    scored = written(weighed(split, added).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    ranked = along(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place"], nth="rank")
    out = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.select(*out, rank.alias("rank")).unionByName(scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))
