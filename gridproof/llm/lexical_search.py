"""Ranked lexical search by a hierarchical max tree over ranges of documents.

Documents are counted once, and only the terms that some item asks for are kept. A shard is a run of counted documents in
order of doc_id. For each term a shard has a tree: its leaves are the documents with the term and what it adds to their
scores, every node above is a range of FAN times as many documents and the most that the term adds in it. An item's bound
for a range is the sum over its terms. Search opens the ranges of the highest bounds first and ends when the highest bound
left is under the item's k-th score so far; ranges of an equal bound are opened, as they may hold a smaller doc_id.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spaced_out, written

#: Documents or ranges under a node, as a power of two; nodes that are opened at a time.
FAN_BITS, OPEN = 4, 8
#: Items are asked in blocks of about so many bytes, which is what is broadcast.
BLOCK_BYTES = 1 << 23
PIECE = 1 << 20


def term_counts(raw: bytes) -> Counter:
    """How often each term (digits, ASCII letters in lower case, bytes beyond ASCII) stands in a UTF-8 text."""
    found: Counter = Counter()
    for words in spaced_out(raw, PIECE):
        found.update(words)
    return found


def count_documents(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; terms and tfs are 32-bit numbers of those in ``terms`` only."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids, sizes, numbers, tfs = [], [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = term_counts(raw.as_py() or b"")
                if counts:
                    asked = counts.keys() & known.keys()
                    ids.append(doc_id)
                    sizes.append(counts.total())
                    numbers.append(np.array([known[w] for w in asked], np.int32).tobytes())
                    tfs.append(np.array([counts[w] for w in asked], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((ids, pa.int64()), (sizes, pa.int64()), (numbers, pa.binary()), (tfs, pa.binary()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for term, n in counted.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # the terms of a block of items
        out[term] = n
    return out


class Level:
    """Nodes of all terms' trees at one height, by term and range: ``node``, ``most``, and where the nodes below begin and end."""

    def __init__(self, node: np.ndarray, most: np.ndarray, below: np.ndarray):
        self.node, self.most, self.first, self.end = node, most, below[:-1], below[1:]


class Shard:
    """The max trees of all terms over some documents."""

    def __init__(self, has_id: np.ndarray, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, per_doc: np.ndarray, weights: np.ndarray, n: int, total: int):
        order = np.lexsort((ids, ~has_id))  # ranges are of neighbouring ids
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.has_id, self.ids = has_id[order], ids[order]
        m = 100 - 90 + (90 * sizes * n) // total
        owner = np.repeat(np.arange(len(ids)), per_doc)
        add = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owner]))
        by = np.lexsort((place[owner], terms))
        term, node, most = terms[by].astype(np.int64), place[owner][by], add[by]
        self.levels = [Level(node, most, np.zeros(len(node) + 1, np.int64))]
        while len(self.levels) == 1 or int(node.max(initial=0)) > 0:
            node = node >> FAN_BITS
            edge = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (node[1:] != node[:-1]), [True]])) if len(node) else np.zeros(1, np.int64)
            most = np.maximum.reduceat(most, edge[:-1]) if len(node) else most
            term, node = term[edge[:-1]], node[edge[:-1]]
            self.levels.append(Level(node, most, edge))
        self.root = np.full(len(weights), -1, np.int64)
        self.root[term] = np.arange(len(term))  # the top has one node for each term

    def search(self, asked: np.ndarray, best: list[tuple[int, bool, int]], k: int) -> list[tuple[int, bool, int]]:
        """The k first of ``best`` and this shard's documents for the terms ``asked``, as (-score, no id, id) in order."""
        roots = self.root[asked]
        roots = roots[roots >= 0]
        height = len(self.levels) - 1
        bound = int(self.levels[height].most[roots].sum())
        if not bound or len(best) == k and bound < -best[-1][0]:
            return best
        heap, made = [(-bound, 0, height, roots)], 1
        while heap:
            least = -best[-1][0] if len(best) == k else 1
            opened: dict[int, list[np.ndarray]] = {}
            for _ in range(OPEN):
                if not heap or -heap[0][0] < least:
                    break
                _, _, at, nodes = heapq.heappop(heap)
                opened.setdefault(at, []).append(nodes)
            if not opened:
                break  # the highest bound left is too low
            for at, some in opened.items():
                nodes, level, below = np.concatenate(some), self.levels[at], self.levels[at - 1]
                size = level.end[nodes] - level.first[nodes]
                flat = np.repeat(level.first[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
                order = np.argsort(below.node[flat], kind="stable")
                flat = flat[order]
                child = below.node[flat]
                edge = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1], [True]]))
                sums = np.add.reduceat(below.most[flat], edge[:-1])
                for i in np.flatnonzero(sums >= least).tolist():
                    if at == 1:
                        place = child[edge[i]]
                        best.append((-int(sums[i]), not self.has_id[place], int(self.ids[place])))
                    else:
                        heapq.heappush(heap, (-int(sums[i]), made, at - 1, flat[edge[i] : edge[i + 1]]))
                        made += 1
            best.sort()
            del best[k:]
        return best


def searched(counted: DataFrame, asked: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item; an item's k-th score goes on from shard to shard."""
    sent = counted.sparkSession.sparkContext.broadcast((asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = sent.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        for batch in batches:
            column = batch.column(0)
            terms, tfs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            shard = Shard(
                column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(terms), np.int32),
                np.frombuffer(b"".join(tfs), np.int32).astype(np.int64), np.array([len(x) // 4 for x in terms], np.int64), w, n, total,
            )
            for i, own in enumerate(items):
                best[i] = shard.search(own, best[i], k)
        rows = [(i, None if no_id else doc_id, -score) for i, found in enumerate(best) for score, no_id, doc_id in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return counted.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item (item_id, text).

    Equal scores are ranked by doc_id, a null doc_id last; every row of ``docs`` (doc_id, text) is a document, repeated ones
    too. Null or empty texts and those without terms are no documents and, as items, find nothing. Items that repeat
    both columns are one; an item_id with two texts is two items, each with ranks of its own, and a null item_id is an
    item. Either table may be empty, which gives an empty result. Other columns are neither read nor returned.

    Items are asked in blocks of about BLOCK_BYTES (their terms and numbers are what is broadcast), one after another, each
    against all documents.
    """
    spark = docs.sparkSession
    plain = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    blocks = max(1, -(-int(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    answer = None
    for block in range(blocks):
        asking = [(r["item_id"], term_counts(bytes(r["text"]))) for r in plain.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        terms = {w: i for i, w in enumerate(sorted({w for _, counts in asking for w in counts}))}
        counted = written(count_documents(docs, terms), "counted")
        n, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in document_frequencies(counted, len(terms)).tolist()], np.int64)
        found = searched(counted, [np.array(sorted(terms[w] for w in counts), np.int64) for _, counts in asking], weights, n, total, k)
        first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(asking)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        answer = part if answer is None else answer.unionByName(part)
    return answer
