"""Embedding near-duplicates by lattice hashing: random projections decoded to points of the E8 lattice.

In each of several tables a unit vector is projected to one or more blocks of eight dimensions, and each block is decoded to
its nearest lattice point; the points together are a cell. A vector is filed under its own cell and under neighbouring
cells nearest to its projection. What is filed is a node number and a sketch of 128 signs, not the vector. Within a cell
the sketches tell which vectors may be within the radius of another; only for those are the vectors brought to that cell,
and verified by cosine in double precision. A pair that shares several cells is counted in the first only, which is
worked out from the vectors alone: cells give counts and spanning links, never their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import components, hot_keys, hub_join, pieces_of, runs_of, union_labels, written

SEED = 8
#: Vectors in a cell that are compared in one piece; a larger one is cut into tiles, and each pair of tiles is dealt by itself.
TILE = 2048
SIGNS = 128
#: Sketches of a cell that are compared in one piece; vectors of a cell where more are at home are all compared.
SKETCHES = 1 << 15
#: Blocks in a table, tables, neighbouring cells, and the lattice's scale: one shape for tables of every size. A vector is
#: filed TABLES * (1 + PROBES) times, 32 bytes each; recall at a cosine of exactly 0.93 is 0.99 (README).
BLOCKS, TABLES, PROBES, SCALE = 2, 6, 3, 2.0


class Lattice:
    """Tables of E8 cells for vectors of one dimension; made from a seed, the same in every task."""

    def __init__(self, dim: int, blocks: int, tables: int, probes: int, scale: float):
        rng = np.random.default_rng(SEED + dim)
        self.blocks, self.tables, self.probes = blocks, tables, probes
        self.scale = scale / math.sqrt(max(dim, 8))
        self.turn = [[np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))[0][:dim] for _ in range(blocks)] for _ in range(tables)]
        self.shift = rng.random((tables, blocks, 8))
        self.mix = rng.integers(1, 1 << 62, (tables, blocks, 8), dtype=np.int64) | 1
        self.planes = rng.standard_normal((dim, SIGNS))
        unit = np.eye(8)
        near = [s * unit[i] + t * unit[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
        half = [np.array([(1 if m >> i & 1 else -1) / 2 for i in range(8)]) for m in range(256) if bin(m).count("1") % 2 == 0]
        self.roots = np.array(near + half)  # the 240 shortest vectors
        each = 5 if blocks <= 2 else 3  # own point and the nearest neighbours of each block that are combined
        self.choices = np.stack(np.meshgrid(*[np.arange(each)] * blocks, indexing="ij"), -1).reshape(-1, blocks)
        self.near = each - 1

    @staticmethod
    def decode(x: np.ndarray) -> np.ndarray:
        """The nearest point of E8: of D8, or of D8 moved by a half, whichever is closer."""

        def d8(y: np.ndarray) -> np.ndarray:
            whole = np.rint(y)
            odd = whole.sum(1).astype(np.int64) & 1 == 1
            if odd.any():  # round the coordinate that is furthest from a whole number the other way
                gap = y[odd] - whole[odd]
                worst = np.abs(gap).argmax(1)
                rows = np.flatnonzero(odd)
                step = np.where(gap[np.arange(len(rows)), worst] >= 0, 1.0, -1.0)
                whole[rows, worst] += step
            return whole

        a, b = d8(x), d8(x - 0.5) + 0.5
        return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)

    def cells(self, unit: np.ndarray, table: int, probes: int | None = None) -> np.ndarray:
        """(n, 1 + probes): a hash of each vector's own cell, then of the neighbouring cells nearest to its projection."""
        parts, costs = [], []
        with np.errstate(over="ignore"):
            for b in range(self.blocks):
                x = unit @ self.turn[table][b] / self.scale + self.shift[table, b]
                own = self.decode(x)
                away = 2 - 2 * (x - own) @ self.roots.T  # how much further each neighbour is
                near = np.argpartition(away, self.near, axis=1)[:, : self.near]
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(away, near, 1), axis=1, kind="stable"), 1)
                points = np.concatenate([own[:, None], own[:, None] + self.roots[near]], axis=1)
                parts.append((np.rint(points * 2).astype(np.int64) * self.mix[table, b]).sum(-1))
                costs.append(np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(away, near, 1)], axis=1))
            cost = sum(c[:, self.choices[:, b]] for b, c in enumerate(costs))
            order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + (self.probes if probes is None else probes)]  # all own comes first, at no cost
            chosen = self.choices[order]
            return sum(np.take_along_axis(p, chosen[:, :, b], 1) for b, p in enumerate(parts)) * 31 + table

    def all_cells(self, unit: np.ndarray) -> np.ndarray:
        return np.stack([self.cells(unit, t) for t in range(self.tables)], axis=1)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """(n, 2) words of 64 signs."""
        return np.packbits(unit @ self.planes > 0, axis=1, bitorder="little").view("<u8")


_LATTICES: dict[tuple, Lattice] = {}


def lattice_for(*key) -> Lattice:
    if key not in _LATTICES:
        _LATTICES[key] = Lattice(*key)
    return _LATTICES[key]


def units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def by_dim(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors in double) of the vectors of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, first = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()[:-1]
    return [(at, flat[first[at][:, None] + np.arange(d)]) for d in np.unique(sizes) for at in [np.flatnonzero(sizes == d)]]


def signs_apart(least: float) -> int:
    """Signs in which two vectors of cosine ``least`` differ, but for one pair in many millions (six deviations)."""
    p = math.acos(least) / math.pi
    return math.ceil(SIGNS * p + 6 * math.sqrt(SIGNS * p * (1 - p)))


def may_match(sketches: np.ndarray, most: int) -> np.ndarray:
    """Whether each sketch is within ``most`` signs of another one."""
    out, step = np.zeros(len(sketches), bool), max(1, (1 << 20) // max(len(sketches), 1))
    for a in range(0, len(sketches), step):
        apart = sum(np.bitwise_count(sketches[a : a + step, None, i] ^ sketches[None, :, i]) for i in range(sketches.shape[1]))  # at most SIGNS: fits a byte
        apart[np.arange(len(apart)), a + np.arange(len(apart))] = most + 1
        out[a : a + step] = (apart <= most).any(1)
    return out


def cell_counts(lattice: Lattice, rows: np.ndarray, label_hash: int, cell: int, tile: np.ndarray, least: float, weight: np.ndarray):
    """Of one cell: for each vector the weight of the partners that are counted here, and each vector's root.

    A pair is counted here if this is the smallest hash in the first table in which the two share a cell.
    """
    n = len(rows)
    unit = units(rows)
    cells = None
    counts, roots = np.zeros(n, np.int64), np.arange(n)
    split = tile.min() != tile.max()
    for a in range(0, n, 512):
        near = unit[a : a + 512] @ unit.T >= least
        i, j = np.nonzero(near)
        i += a
        keep = (i < j) & ((tile[i] != tile[j]) if split else True)
        i, j = i[keep], j[keep]
        if len(i) and cells is None:
            cells = bucket_hash(lattice.all_cells(unit), label_hash)
        for c in range(0, len(i), 1 << 15):
            p, q = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
            place, open_ = np.zeros(len(p), np.int64), np.ones(len(p), bool)
            for t in range(lattice.tables):
                one, two = cells[p[open_], t], cells[q[open_], t]
                both = np.where((one[:, :, None] == two[:, None, :]).any(2), one, np.iinfo(np.int64).max).min(1)
                met = both < np.iinfo(np.int64).max
                at = np.flatnonzero(open_)[met]
                place[at], open_[at] = both[met], False
                if not open_.any():
                    break
            here = (place == cell) & ~open_
            p, q = p[here], q[here]
            np.add.at(counts, p, weight[q])
            np.add.at(counts, q, weight[p])
            roots = union_labels(n, p, q, roots)
    return counts, roots


def bucket_hash(cells: np.ndarray, label_hash: np.ndarray | int) -> np.ndarray:
    """Cells of different labels apart, and the bits well mixed."""
    with np.errstate(over="ignore"):
        x = (cells + label_hash).view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def own_cells(nodes: DataFrame, shape: tuple) -> DataFrame:
    """(bucket, n): how many vectors have each cell for their own; a task adds up first."""

    def run(batches):
        for batch in batches:
            out = []
            for at, rows in by_dim(batch.column(1)):
                lattice, unit, labels = lattice_for(rows.shape[1], *shape), units(rows), batch.column(0).to_numpy()[at]
                out += [bucket_hash(lattice.cells(unit, t, 0)[:, 0], labels) for t in range(lattice.tables)]
            key, n = np.unique(np.concatenate(out), return_counts=True) if out else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["bucket", "n"])

    return nodes.select("label_hash", "e").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def file_under(nodes: DataFrame, shape: tuple) -> DataFrame:
    """(bucket, node, s, t): each vector's number and sketch under its cells."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for at, rows in by_dim(batch.column(2)):
                lattice, unit = lattice_for(rows.shape[1], *shape), units(rows)
                number, labels, sketch = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at], lattice.sketch(unit).view(np.int64)
                for t in range(lattice.tables):
                    cells = bucket_hash(lattice.cells(unit, t), labels[:, None])
                    for x, y in zip(out, (cells.ravel(), *(np.repeat(z, cells.shape[1]) for z in (number, sketch[:, 0], sketch[:, 1])))):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], ["bucket", "node", "s", "t"])

    return nodes.select("node", "label_hash", "e").mapInArrow(run, "bucket long, node long, s long, t long")


def candidates(nodes: DataFrame, shape: tuple, least: float) -> DataFrame:
    """(bucket, node): the vectors that have another one near them, by their sketches, in each cell.

    Of cells with many vectors at home all are taken, so that no task compares a large one.
    """
    most = signs_apart(least)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = file_under(nodes, shape)
    large = written(own_cells(nodes, shape).where(F.col("n") > SKETCHES).select("bucket"), "large-cells")

    def run(batches):
        for part in pieces_of(batches, "bucket"):
            keys, number, sketch = part["bucket"].to_numpy(), part["node"].to_numpy(), np.stack([part["s"].to_numpy(), part["t"].to_numpy()], 1).view(np.uint64)
            hits = [a + np.flatnonzero(may_match(sketch[a:b], most)) for a, b in runs_of(keys)]
            at = np.concatenate(hits) if hits else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(number[at])], ["bucket", "node"])

    some = not large.isEmpty()
    rest = filed.join(large, "bucket", "left_anti") if some else filed
    near = rest.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, node long")
    return near.unionByName(filed.join(large, "bucket", "left_semi").select("bucket", "node")) if some else near


def verified(met: DataFrame, nodes: DataFrame, shape: tuple, least: float) -> DataFrame:
    """(node, n, root) of the vectors that have links in a cell, summed over that cell."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = written(met.groupBy("bucket").agg(F.count("*").alias("n")), "cell-sizes")
    tiles = sizes.where("n > 1").select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    dealt = hub_join(met, tiles, "bucket", hot_keys(sizes, "bucket", met.count())).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("node", "bucket", "own", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("deal"))
    held = tiled.join(nodes.select("node", "weight", "label_hash", "e"), "node")
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def run(batches):
        for part in pieces_of(batches, "deal"):
            number, weight, own, bucket, labels = (part[c].to_numpy() for c in ("node", "weight", "own", "bucket", "label_hash"))
            vectors = part["e"].combine_chunks()
            out = ([], [], [])
            for a, b in runs_of(part["deal"].to_numpy()):
                rows = vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
                counts, roots = cell_counts(lattice_for(rows.shape[1], *shape), rows, labels[a], bucket[a], own[a:b], least, weight[a:b])
                hit = np.flatnonzero(counts)
                for x, y in zip(out, (number[a:b][hit], counts[hit], number[a:b][roots[hit]])):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], schema=schema)

    return held.repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(run, "node long, n long, root long")


def lattice_groups(vectors: DataFrame, least: float = 0.93, blocks: int = BLOCKS, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label and one length are linked at a cosine of ``least`` or more. A vector is a vec_id with an
    embedding and a label: rows that repeat all three are one, each answered; a vec_id with two embeddings is two
    vectors, which are counted and linked as others are. Equal embeddings of a label are one node with a weight. A null
    label, a null or empty embedding, a zero vector, one with null or non-finite components, and a null vec_id link
    with nothing: no links, their own component. An empty table gives an empty result; other columns are neither
    read nor returned.

    Two random vectors of a label share a cell of a table once in about 6,500 times; the sketches of those that do are
    compared, so this part grows with the square of a label's vectors, spread over cells. More ``blocks`` make cells finer.
    """
    kind = "double" if vectors.schema["embedding"].dataType.elementType == DoubleType() else "float"
    plain = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("e"), F.col("label").cast("string").alias("label"))
    sound = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND size(e) > 0 AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(e, x -> x <> 0)")
    e = F.transform("e", lambda x: x + F.lit(0.0).cast(kind))  # -0.0 as 0.0
    rows = plain.withColumn("e", F.when(F.coalesce(sound, F.lit(False)), e))

    def content(x: Column) -> list[Column]:
        """128 bits of what a node is told by."""
        return [F.xxhash64("label", x).alias("h"), F.xxhash64(F.lit("again"), x, "label").alias("g")]

    keyed = rows.where("e IS NOT NULL").select("vec_id", "label", "e", *content(F.col("e")))
    owners = keyed.select("h", "g", "vec_id").distinct().groupBy("h", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    once = keyed.groupBy("h", "g").agg(F.first("label").alias("label"), F.first("e").alias("e"))
    numbered = once.join(owners, ["h", "g"]).select(F.monotonically_increasing_id().alias("node"), "h", "g", "least", "weight", F.xxhash64("label", F.size("e")).alias("label_hash"), "e")
    nodes = written(numbered, "vectors")

    shape = (blocks, tables, probes, scale)
    met = written(candidates(nodes, shape, least), "met")
    found = written(verified(met, nodes, shape, least), "counts")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "of")
    joined = nodes.drop("e", "label_hash").join(counts, "node", "left").join(roots, F.col("node") == F.col("of"), "left")
    named = written(joined.select("h", "g", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "roots")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    answer = hub_join(named, lowest.drop("n"), "root", hot_keys(lowest, "root", named.count())).select("h", F.col("g").alias("other"), "n_links", "component_id")

    asked = rows.select("vec_id", F.col("e").isNotNull().alias("sound"), *content(F.col("e")))
    copies = asked.where("sound").groupBy("h").agg(F.count("*").alias("n"))
    known = hub_join(asked.where("sound"), answer, "h", hot_keys(copies, "h", asked.count())).where("g = other").select("vec_id", F.col("n_links").cast("long"), "component_id")
    alone = asked.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
