"""SimHash near-duplicates: fingerprints that differ in few bits, compared bit plane by bit plane.

Candidates share ``blocks - radius`` of the fingerprint's blocks, which any two within the radius do, so that the
search is exact. In a bucket the fingerprints stand vertically (a plane for each bit, 64 of them in a machine word);
a query's distances to 64 others at a time are counted by carry-save adders over the planes, and the words in which
all 64 counts have passed the radius are abandoned on the way.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, hot_keys, hub_join, packed, slabs, text_column, union_labels, written

SEED = 42
LANES = 64
#: Fingerprints in a bucket; a larger one is cut into tiles, and each pair of tiles is a bucket of its own.
TILE = 2048
#: Words of work at a time in the bit-sliced comparison.
WORK = 1 << 18
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
TO_LOWER = bytes.maketrans(UPPER, LOWER)


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of each shingle of ``words`` words in lower case, repeats included; fewer words are one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    if not found:
        return []
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(b" ".join(found), SEED)]
    joined = b" ".join(found)
    starts, at = [], 0
    for w in found:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[words:]] + [len(joined)]
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends)]


def fingerprints_of(texts: list[str | None], words: int) -> np.ndarray:
    """64-bit fingerprints: a bit is set where over half the hashes have it."""
    hashes = [shingle_hashes(t, words) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, h in enumerate(hashes):
        if h:
            ones = np.zeros(64, np.int64)
            flat = np.array(h, np.uint64)
            for a in range(0, len(flat), 1 << 15):
                ones += np.unpackbits(flat[a : a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i] = weight[2 * ones > sizes[i]].sum()
    return out


def fingerprint(text: Column, words: int) -> Column:
    """The fingerprint of a text as a signed long."""

    def work(texts: list[str | None]) -> dict:
        parts = [fingerprints_of(texts[a:b], words) for a, b in slabs(np.array([len(t or "") for t in texts]), 1_000_000)]
        return {"fp": (np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64)}

    return text_column("fp long", work)(text)["fp"]


def block_masks(blocks: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def key_masks(blocks: int, radius: int) -> list[int]:
    """A mask for each choice of ``blocks - radius`` blocks: two fingerprints within the radius agree under one of them."""
    return [sum(c) for c in combinations(block_masks(blocks), blocks - radius)]


def sliced_links(fp: np.ndarray, start: np.ndarray, stop: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i, j), i < j, within the radius, where j is in [start[i], stop[i]) of the array; and the words of work done."""
    first = np.arange(len(fp))
    # one unit of work: a query against a word of 64 neighbours in the array
    begin = np.maximum(first + 1, start) // LANES
    end = -(-stop // LANES)
    units = np.maximum(end - begin, 0)
    planes = np.zeros((64, -(-len(fp) // LANES)), np.uint64)
    padded = np.zeros(planes.shape[1] * LANES, np.uint64)
    padded[: len(fp)] = fp
    for k in range(64):
        bits = ((padded >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)
        planes[k] = np.packbits(bits, bitorder="little").view("<u8")
    left, right, done = [], [], 0
    for a, b in slabs(units, WORK):
        n = units[a:b]
        q = np.repeat(np.arange(a, b), n)
        word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[a:b], n)
        done += len(q)
        value = fp[q]
        digits = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
        over = np.zeros(len(q), np.uint64)
        for k in range(64):
            carry = planes[k, word] ^ (np.uint64(0) - ((value >> np.uint64(k)) & np.uint64(1)))
            for d in range(len(digits)):  # carry-save: add a bit to 64 counters at once
                digits[d], carry = digits[d] ^ carry, digits[d] & carry
            over |= carry
            if k % 8 == 7:
                full = over.copy()
                bigger = np.zeros(len(q), np.uint64)
                same = ~np.zeros(len(q), np.uint64)
                for d in range(len(digits) - 1, -1, -1):  # counters above the radius, from the highest digit
                    if radius >> d & 1:
                        same &= digits[d]
                    else:
                        bigger |= same & digits[d]
                        same &= ~digits[d]
                full |= bigger
                over = full
                open_ = full != ~np.uint64(0)
                if k < 63 and not open_.all():  # abandon words in which all are beyond the radius
                    q, word, value, over = q[open_], word[open_], value[open_], over[open_]
                    digits = [x[open_] for x in digits]
        if len(q):
            hit = np.flatnonzero(over != ~np.uint64(0))
            for c in range(0, len(hit), 1 << 14):
                h = hit[c : c + (1 << 14)]
                r, lane = np.nonzero(np.unpackbits((~over[h]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                i, j = q[h[r]], word[h[r]] * LANES + lane
                ok = (j > i) & (j >= start[i]) & (j < stop[i])
                left.append(i[ok])
                right.append(j[ok])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else empty), (np.concatenate(right) if right else empty), done


def forest(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by bucket: links (fp, fp of its root) that join what the bucket's pairs within the radius join."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    alone = np.repeat(size == 1, size)
    fp, size = fp[~alone], size[size > 1]
    if not len(fp):
        return fp, fp
    stop = np.repeat(np.cumsum(size), size)
    start = np.repeat(np.cumsum(size) - size, size)
    a, b, _ = sliced_links(fp.view(np.uint64), start, stop, radius)
    root = union_labels(len(fp), a, b)
    moved = root != np.arange(len(fp))
    return fp[moved], fp[root[moved]]


def links(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp`` that join exactly those that pairs within ``radius`` bits join.

    Buckets with more than TILE fingerprints are dealt out as pairs of tiles. A bucket gives a spanning forest of its
    pairs, fewer links than it has fingerprints.
    """
    masks = key_masks(blocks, radius)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("t", "k"))
    keyed = keyed.select("fp", F.xxhash64("t", "k").alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    dealt = keyed.join(large, "key", "left").select("fp", "key", F.coalesce("tiles", F.lit(1)).alias("tiles"), F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("tiles", F.lit(1))).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = dealt.select("fp", "key", "own", other.alias("other")).select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))

    def run(batches):
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def give(key, fp):
            a, b = forest(key, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            cut = np.searchsorted(key, key[-1]) if len(key) else 0  # the last bucket may go on in the next batch
            yield give(key[:cut], fp[:cut])
            rest_key, rest_fp = key[cut:], fp[cut:]
        yield give(rest_key, rest_fp)

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiled.select("key", "fp").repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def groups_of(prints: DataFrame, radius: int, blocks: int) -> tuple[DataFrame, list]:
    """(fp, least, component_id, first) of each distinct fingerprint of ``prints`` (doc_id, fp), and the hot fingerprints.

    ``least`` is the smallest doc_id with that fingerprint, ``component_id`` the smallest of the component, and
    ``first`` marks the one fingerprint of a component that the document to keep has (null doc_ids come last).
    """
    counted = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-counts")
    hot = hot_keys(counted, "fp", prints.count())
    nodes = counted.select("fp", "least")
    roots = components(links(nodes.select("fp"), radius, blocks))
    named = written(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull(), "least", "fp"))["fp"].alias("of"), F.count("*").alias("n"))
    joined = hub_join(named, lowest.drop("n"), "root", hot_keys(lowest, "root", named.count()))
    return joined.select("fp", "least", "component_id", (F.col("fp") == F.col("of")).alias("first")), hot


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of at most ``radius`` bits).

    A null or empty text has fingerprint zero, linked like any other. Rows with the same fingerprint are one node.
    Repeated rows stay, each with its component; a null doc_id is ignored in the smallest, and a component of such rows only
    has a null id. An empty table gives an empty result. Other columns are neither read nor returned.
    """
    prints = written(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp")), "fingerprints")
    owner, hot = groups_of(prints, radius, blocks)
    answer = hub_join(prints, owner.select("fp", "component_id"), "fp", hot)
    return answer.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """The rows of ``docs`` to keep, with all their columns: of each component one row.

    That is the row with the smallest doc_id (any other before null), among several with it the one with the smallest
    fingerprint, then the smallest text (null first). Rows are told apart by doc_id and fingerprint, not by doc_id alone. The
    texts are shuffled once; rows of a (doc_id, fingerprint) that many have stay where they are, and each task gives one
    of them. Null and empty texts have fingerprint zero, an empty table stays one, and no column of ``docs`` can clash.
    """
    prints = written(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp")), "fingerprints")
    owner, _ = groups_of(prints, radius, blocks)

    def key(doc_id: str, fp: str) -> list[Column]:
        return [F.xxhash64(doc_id, F.col(doc_id).isNull(), fp).alias("key"), F.coalesce(doc_id, F.lit(0)), F.col(doc_id).isNull(), F.col(fp)]

    keep = owner.where("first").select(*[c.alias(n) for c, n in zip(key("least", "fp"), ("key", "keep_id", "keep_null", "keep_fp"))])
    marked = packed(docs, "doc_id", "text").withColumn("fp", fingerprint(F.col("text"), words)).select("row", "text", *[c.alias(n) for c, n in zip(key("doc_id", "fp"), ("key", "own_id", "own_null", "own_fp"))])
    hot = hot_keys(prints.select(key("doc_id", "fp")[0]).groupBy("key").agg(F.count("*").alias("n")), "key", prints.count())
    same = (F.col("own_id") == F.col("keep_id")) & (F.col("own_null") == F.col("keep_null")) & (F.col("own_fp") == F.col("keep_fp"))

    def one(found: DataFrame) -> DataFrame:
        first = F.min_by("row", F.struct(F.col("text").isNotNull(), F.coalesce("text", F.lit(""))))
        return found.where(same).groupBy("key", "own_id", "own_null", "own_fp").agg(first.alias("row")).select("row.*")

    rest = one(marked.where(~F.col("key").isin(hot)).join(keep, "key") if hot else marked.join(keep, "key"))
    if not hot:
        return rest
    return rest.unionByName(one(marked.where(F.col("key").isin(hot)).join(F.broadcast(keep.where(F.col("key").isin(hot))), "key")))
