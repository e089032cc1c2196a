"""Token ids in directly addressable codes: any token is read without decoding those before it.

An id is cut into chunks of WIDTH bits. Level 0 has the lowest chunk of every id and a bitmap of the ids that go on;
level 1 has the next chunk of those only, and so on. The place of an id on the next level is the rank of its bit,
which a directory of counts for each 512 bits gives in a few steps.

A file is Parquet written by Spark, a row for each segment of whole documents in ascending doc_id order: ``part`` and
``base`` (the range of documents, and the ids of that range before the segment), ``doc_ids`` (validity byte and
64-bit id for each), ``ends`` (64-bit ids up to each document's end) and, by level, ``chunks``, ``bitmaps``, ``ranks``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batch, shared_dir, slabs
from .tokens import chunk_table

WIDTH = 8
BLOCK = 512
#: Ids after which a segment ends; a document stays whole.
SEGMENT = 1 << 18
SCHEMA = "part int, base long, n_ids long, doc_ids binary, ends binary, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(chunks, bitmaps, ranks) by level."""
    chunks, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        more = rest >> WIDTH > 0
        chunks.append((rest & ((1 << WIDTH) - 1)).astype(np.uint8).tobytes())
        bits = np.zeros(-(-max(len(rest), 1) // BLOCK) * BLOCK, np.uint8)
        bits[: len(rest)] = more
        bitmaps.append(np.packbits(bits, bitorder="little").tobytes())
        per = bits.reshape(-1, BLOCK).sum(1, dtype=np.uint32)
        ranks.append((np.cumsum(per, dtype=np.uint32) - per).astype("<u4").tobytes())
        if not more.any():
            return chunks, bitmaps, ranks
        rest = rest[more] >> WIDTH


class Codes:
    """Random access to one segment's ids."""

    def __init__(self, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(x, np.uint8) for x in chunks]
        self.words = [np.frombuffer(x, "<u8") for x in bitmaps]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    def __len__(self) -> int:
        return len(self.chunks[0])

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before ``at``."""
        words, word = self.words[level], at >> 6
        inside = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        if len(at) > len(words):  # for many places at once, the counts before every word
            before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            return before[word] + np.bitwise_count(words[word] & inside)
        out = self.ranks[level][at // BLOCK].astype(np.int64)
        first = at // BLOCK * (BLOCK // 64)
        for k in range(BLOCK // 64 - 1):
            more = first + k < word
            out[more] += np.bitwise_count(words[(first + k)[more]])
        return out + np.bitwise_count(words[word] & inside)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at the places ``at``, in any order."""
        at = np.asarray(at, np.int64)
        out = self.chunks[0][at].astype(np.uint32)
        who = np.arange(len(at))
        for level in range(len(self.chunks) - 1):
            more = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            at, who = self.rank(level, at[more]), who[more]
            if not len(at):
                break
            out[who] |= self.chunks[level + 1][at].astype(np.uint32) << np.uint32(WIDTH * (level + 1))
        return out


def encoded(docs: DataFrame, tokenizer: str, drops_space: bool, end_id: int) -> DataFrame:
    """Rows of the file format; documents dealt by ranges of doc_id and sorted."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        table, part, base = chunk_table(tokenizer, drops_space), TaskContext.get().partitionId(), 0
        names, ids, n = [], [], 0

        def segment():
            flat = np.frombuffer(b"".join(ids), "<u4")
            chunks, bitmaps, ranks = pack(flat)
            known = b"".join(bytes([d is not None]) + int(d or 0).to_bytes(8, "little", signed=True) for d in names)
            row = {"part": part, "base": base, "n_ids": len(flat), "doc_ids": known, "ends": np.cumsum([len(x) // 4 for x in ids]).astype("<i8").tobytes(), "chunks": chunks, "bitmaps": bitmaps, "ranks": ranks}
            return pa.RecordBatch.from_arrays([pa.array([row[f]], type=t) for f, t in kinds], [f for f, _ in kinds])

        binary = pa.list_(pa.binary())
        kinds = [("part", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("ends", pa.binary()), ("chunks", binary), ("bitmaps", binary), ("ranks", binary)]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            doc_ids = batch.column(0).to_pylist()
            for a, b in slabs(np.array([len(t or "") for t in texts]), 1_000_000):
                for d, x in zip(doc_ids[a:b], table.encode(texts[a:b])):
                    names.append(d)
                    ids.append(x + tail)
                    n += len(x) // 4 + 1
                    if n >= SEGMENT:
                        yield segment()
                        base += n
                        names, ids, n = [], [], 0
        if names:
            yield segment()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges may end within one doc_id, by how its texts begin: rows without an id are not all one task's
    ranged = docs.select("doc_id", "text", F.substring("text", 1, 64).alias("begins")).repartitionByRange(parts, "doc_id", "begins")
    source = ranged.select("doc_id", "text").sortWithinPartitions("doc_id", "text")
    return source.mapInArrow(run, SCHEMA)


def write_codes(docs: DataFrame, path: str, tokenizer: str, drops_space: bool = True, end_id: int = 2) -> None:
    """Encodes every whole text (null: empty), appends ``end_id`` and writes the file at ``path``.

    Equal doc_ids stand in order of their texts, null ones first. An empty table writes a file without rows.
    """
    encoded(docs, tokenizer, drops_space, end_id).write.parquet(path)


def open_codes(spark: SparkSession, path: str) -> DataFrame:
    """The segments at ``path`` with ``first``: the ids of all segments before."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of documents
    before = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("first", F.col("before") + F.col("base"))


def doc_directory(row_ids: bytes, ends: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids of a segment, and where each starts and ends."""
    raw = np.frombuffer(row_ids, np.dtype([("known", "u1"), ("id", "<i8")]))
    end = np.frombuffer(ends, "<i8")
    return [int(i) if k else None for k, i in raw.tolist()], np.concatenate([[0], end[:-1]]), end


def documents_of(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of each document, read from the segments."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                names, start, end = doc_directory(r["doc_ids"], r["ends"])
                ids = Codes(r["chunks"], r["bitmaps"], r["ranks"]).get(np.arange(r["n_ids"])).astype("<u4")
                out = [pa.array(names, pa.int64()), pa.array(r["first"] + start), pa.array(end - start), pa.array([zlib.crc32(ids[a:b]) for a, b in zip(start, end)], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("doc_ids", "ends", "n_ids", "first", "chunks", "bitmaps", "ranks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, pos, token) for the rows (doc_id, pos) of ``wanted``; a place outside its document gives null.

    Only the segments that hold a wanted document are shuffled, and no segment is decoded. Null doc_ids find nothing.
    """

    def directory(batch: pa.RecordBatch) -> dict:
        rows = [(d, f, int(s), int(e)) for f, ids, ends in zip(*(batch.column(i).to_pylist() for i in range(3))) for d, s, e in zip(*doc_directory(ids, ends))]
        return dict(zip(("doc_id", "first", "s", "e"), map(list, zip(*rows)))) if rows else {c: [] for c in ("doc_id", "first", "s", "e")}

    where = by_batch(segments, ["first", "doc_ids", "ends"], "doc_id long, first long, s long, e long", directory)
    asked = wanted.select("doc_id", "pos").join(where, "doc_id")

    def read(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[["doc_id", "pos"]].assign(token=pd.Series([None] * len(left), dtype="Int64"))
        inside = ((left.pos >= 0) & (left.pos < left.e - left.s)).to_numpy()
        if len(right) and inside.any():
            r = right.iloc[0]
            out.loc[inside, "token"] = Codes(r.chunks, r.bitmaps, r.ranks).get((left.s + left.pos)[inside].to_numpy()).astype("int64")
        return out

    held = segments.join(asked.select("first").distinct(), "first", "left_semi").select("first", "chunks", "bitmaps", "ranks")
    return asked.groupBy("first").cogroup(held.groupBy("first")).applyInPandas(read, "doc_id long, pos long, token long")


def new_path(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/gridproof/codes-{uuid.uuid4().hex}"
