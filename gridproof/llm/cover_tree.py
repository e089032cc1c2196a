"""Exact top-k search by inner product: a dual-tree search of cover trees over queries and data.

Vectors are dealt into shelves: by the pivot that is nearest, and within a pivot's vectors in tiles of bounded size. Pivots
are a net over a bounded sample, but every vector is dealt, and a pivot's covering radius is taken over all vectors that it
got. A query goes to the shelves of those pivots alone whose bound reaches the query's floor: its k-th score among the
sample. A task builds the cover tree of a shelf and, for each group of queries that comes to it, a tree of these; pairs
of nodes whose bound is under the worst k-th score of the query node are pruned. A query's best of all shelves are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors of the sample that pivots are made from and floors are taken among; pivots; components in a tile.
SAMPLE, PIVOTS, TILE = 2048, 64, 1 << 23
#: Components of the whole sample, which is broadcast.
SAMPLE_SIZE = 1 << 20
#: Children of a node, points of a leaf, queries that are searched together, points that are scored at a time.
FAN, LEAF, GROUP, POINTS = 16, 64, 1024, 2048


def farthest_first(x: np.ndarray, most: int, first: int, halve: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, owner, distance): a greedy net. Each next centre is the point that is furthest from all before it.

    Centres are at least as far apart as any point is from its centre, which are the two invariants of a cover tree's
    level. With ``halve`` no more centres are taken once that radius is half of the first.
    """
    centres, owner = [first], np.zeros(len(x), np.int64)
    away = np.sqrt(((x - x[first]) ** 2).sum(1))
    begun = away.max(initial=0)
    while len(centres) < most:
        far = int(away.argmax())
        if away[far] == 0 or halve and away[far] <= begun / 2:
            break
        d = np.sqrt(((x - x[far]) ** 2).sum(1))
        nearer = d < away
        owner[nearer], away[nearer] = len(centres), d[nearer]
        centres.append(far)
    return np.array(centres), owner, away


class CoverTree:
    """Nodes over points, which are in order of the nodes: ``centre``, ``radius`` and ``most`` (the largest squared length) of each,
    its points ``start:end``, and its children ``child:child_end``, none for a leaf."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.x = x.astype(np.float64)
        squares = (self.x**2).sum(1)
        centre, radius, most, start, end, child, child_end = [], [], [], [], [], [], []

        def node(a: int, b: int, c: int, r: float) -> None:
            for column, v in ((centre, c), (radius, r), (most, squares[self.order[a:b]].max(initial=0)), (start, a), (end, b), (child, 0), (child_end, 0)):
                column.append(v)

        first = int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin())
        node(0, len(x), first, float(np.sqrt(((self.x - self.x[first]) ** 2).sum(1)).max()))
        at = 0
        while at < len(centre):  # breadth first, so that siblings are neighbours
            a, b = start[at], end[at]
            if b - a > LEAF and radius[at] > 0:
                own = self.order[a:b].copy()
                centres, owner, away = farthest_first(self.x[own], FAN, int(np.flatnonzero(own == centre[at])[0]), True)
                by = np.argsort(owner, kind="stable")
                self.order[a:b] = own[by]
                sizes = np.bincount(owner, minlength=len(centres))
                child[at], place = len(centre), a
                for i, n in enumerate(sizes.tolist()):
                    node(place, place + n, int(own[centres[i]]), float(away[owner == i].max(initial=0)))
                    place += n
                child_end[at] = len(centre)
            at += 1
        self.centre = self.x[np.array(centre)]
        self.length = np.sqrt((self.centre**2).sum(1))
        self.radius, self.most = np.array(radius), np.array(most)
        self.start, self.end, self.child, self.child_end = (np.array(v, np.int64) for v in (start, end, child, child_end))


def bounds(centre: np.ndarray, radius: float, most: float, centres: np.ndarray, radii: np.ndarray, mosts: np.ndarray) -> np.ndarray:
    """The most that a product of a vector around ``centre`` with one around each of ``centres`` can be.

    By the covering radii: from the products of the centres, and from how near to each other the vectors can be. The last
    bits of the doubles are allowed for.
    """
    length, lengths = math.sqrt((centre**2).sum()), np.sqrt((centres**2).sum(1))
    by_product = centres @ centre + length * radii + lengths * radius + radius * radii
    gap = np.maximum(np.sqrt(((centres - centre) ** 2).sum(1)) - radius - radii, 0)
    by_distance = (most + mosts - gap**2) / 2
    return np.minimum(by_product, by_distance) + 1e-9 * (most + mosts) + 0.5


class Search:
    """The k best candidates of some queries. Equal candidates are one point that carries its smallest k + 1 ids."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int):
        by = np.lexsort((ids, *x.T)) if x.shape[1] else np.argsort(ids, kind="stable")
        x, ids = x[by], ids[by]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
        which = np.cumsum(new) - 1
        again = np.concatenate([[False], (which[1:] == which[:-1]) & (ids[1:] == ids[:-1])])  # repeated rows
        which, ids = which[~again], ids[~again]
        nth = np.arange(len(which)) - np.searchsorted(which, which)
        self.ids, self.count = ids[nth <= k], np.bincount(which[nth <= k])
        self.first = np.cumsum(self.count) - self.count
        self.k, self.points = k, x[new]
        self.tree = CoverTree(self.points)
        self.small = float((self.points.astype(np.float64) ** 2).sum(1).max(initial=0))

    def products(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact products: by float32 or float64 where no partial sum can leave the whole numbers that they hold, else in 64 bits."""
        reach = math.sqrt(self.small * float((q.astype(np.float64) ** 2).sum(1).max(initial=0)))
        kind = np.float32 if reach < 2**23 else np.float64 if reach < 2**52 else np.int64
        return (q.astype(kind) @ self.points[at].astype(kind).T).astype(np.int64)

    def best(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of each query's k best, of those with ``floor`` or more; equal scores by id. ``own`` ids are left out."""
        self.q, self.own, self.worst = q, own, floor.astype(np.float64)
        self.found = (np.zeros(0, np.int64),) * 3
        tree = CoverTree(q)
        self.visit(tree, 0, np.zeros(1, np.int64))
        row, score, ids = self.found
        cut = np.searchsorted(row, np.arange(len(q) + 1))
        return [(score[a:b], ids[a:b]) for a, b in zip(cut[:-1], cut[1:])]

    def alive(self, queries: CoverTree, at: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes, highest bound first, that may hold one of the k best of a query under node ``at``; and their bounds."""
        t = self.tree
        most = bounds(queries.centre[at], queries.radius[at], queries.most[at], t.centre[nodes], t.radius[nodes], t.most[nodes])
        keep = np.flatnonzero(most >= self.worst[queries.order[queries.start[at] : queries.end[at]]].min())
        keep = keep[np.argsort(-most[keep], kind="stable")]
        return nodes[keep], most[keep]

    def below(self, nodes: np.ndarray) -> np.ndarray:
        t = self.tree
        size = t.child_end[nodes] - t.child[nodes]
        return np.repeat(t.child[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def visit(self, queries: CoverTree, at: int, nodes: np.ndarray) -> None:
        nodes, most = self.alive(queries, at, nodes)
        if queries.child[at] == queries.child_end[at]:
            self.leaf(queries, at, nodes, most)
            return
        t = self.tree
        wide = (t.child_end[nodes] > t.child[nodes]) & (t.radius[nodes] >= queries.radius[at])  # the larger side is opened
        nodes = np.concatenate([nodes[~wide], self.below(nodes[wide])])
        for child in range(queries.child[at], queries.child_end[at]):
            self.visit(queries, child, nodes)

    def leaf(self, queries: CoverTree, at: int, nodes: np.ndarray, most: np.ndarray) -> None:
        """Best first: the points of the leaves, and the children of the others, with the highest bounds."""
        rows, t = queries.order[queries.start[at] : queries.end[at]], self.tree
        while len(nodes):
            taken = max(1, int(np.searchsorted(np.cumsum(t.end[nodes] - t.start[nodes]), POINTS)))
            now, nodes, most = nodes[:taken], nodes[taken:], most[taken:]
            inner = t.child_end[now] > t.child[now]
            if (~inner).any():
                self.score(rows, np.concatenate([t.order[t.start[i] : t.end[i]] for i in now[~inner]]))
            keep = most >= self.worst[rows].min()
            nodes, most = nodes[keep], most[keep]
            if inner.any():
                new, new_most = self.alive(queries, at, self.below(now[inner]))
                nodes, most = np.concatenate([nodes, new]), np.concatenate([most, new_most])
                by = np.argsort(-most, kind="stable")
                nodes, most = nodes[by], most[by]

    def score(self, rows: np.ndarray, points: np.ndarray) -> None:
        scores = self.products(self.q[rows], points)
        least = np.full(len(rows), np.iinfo(np.int64).min)
        if len(points) > self.k + 1:  # one of k + 1 may be the query itself
            least = np.partition(scores, len(points) - self.k - 1, axis=1)[:, len(points) - self.k - 1]
        i, j = np.nonzero((scores >= self.worst[rows][:, None]) & (scores >= least[:, None]))
        size = self.count[points[j]]
        flat = np.repeat(self.first[points[j]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        row, score, ids = np.repeat(rows[i], size), np.repeat(scores[i, j], size), self.ids[flat]
        other = ids != self.own[row]
        row, score, ids = (np.concatenate([a, b[other]]) for a, b in zip(self.found, (row, score, ids)))
        by = np.lexsort((ids, -score, row))
        row, score, ids = row[by], score[by], ids[by]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        last = nth == self.k - 1
        self.worst[row[last]] = np.maximum(self.worst[row[last]], score[last])
        keep = nth < self.k
        self.found = (row[keep], score[keep], ids[keep])


# --- dealing -----------------------------------------------------------------------------------------------------


class Pivots:
    """For each length of vector: the sample, its net, and after ``cover`` the reach of each pivot over all its vectors."""

    def __init__(self, rows: list[tuple[int, list[int]]], k: int):
        self.k, self.ids, self.sample, self.net, self.reach = k, {}, {}, {}, {}
        size = 0
        by: dict[int, dict[tuple, None]] = {}
        for vec_id, e in rows:
            if (size := size + len(e)) > SAMPLE_SIZE:
                break
            by.setdefault(len(e), {})[(vec_id, tuple(e))] = None
        for d, found in by.items():
            x = np.array([e for _, e in found], np.float64).reshape(len(found), d)
            self.ids[d], self.sample[d] = np.array([i for i, _ in found], np.int64), x
            self.net[d] = x[farthest_first(x, PIVOTS, 0, False)[0]]

    def centres(self, d: int) -> np.ndarray:
        """Vectors of a length that the sample lacks share one pivot, zero."""
        return self.net.get(d, np.zeros((1, d)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.centres(x.shape[1])
        at = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        return at, np.sqrt(((x - c[at]) ** 2).sum(1))

    def floors(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The k-th score of each query among the sample's other ids, a little less for the doubles; none where the sample is smaller."""
        d = x.shape[1]
        if len(self.ids.get(d, ())) <= self.k:
            return np.full(len(x), -np.inf)
        scores = np.where(self.ids[d][None, :] == own[:, None], -np.inf, x @ self.sample[d].T)
        kth = np.sort(scores, axis=1)[:, -self.k]
        return kth - 1e-9 * np.abs(kth) - 0.5

    def shelves(self, x: np.ndarray, floor: np.ndarray) -> list[np.ndarray]:
        """For each query the pivots of whose vectors one may score its floor or more."""
        d = x.shape[1]
        at, radius, most = self.reach[d]
        c = self.centres(d)[at]
        return [at[bounds(q, 0.0, float((q**2).sum()), c, radius, most) >= f] for q, f in zip(x, floor)]


def vectors_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, whole vectors as doubles) of each length in a batch."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, first = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()[:-1]
    return [(at, flat[first[at][:, None] + np.arange(d)]) for d in np.unique(sizes) for at in [np.flatnonzero(sizes == d)]]


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, e) with e = floor(scale * x) of each component, of the vectors that take part."""
    kind = "array<double>"
    e = F.col("embedding").cast(kind)
    sound = F.expr("vec_id IS NOT NULL AND e IS NOT NULL AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    length = F.aggregate("e", F.lit(0.0), lambda a, x: a + (F.lit(scale) * x) * (F.lit(scale) * x))
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where(sound & (length < 2.0**60))
    return some.select("vec_id", F.transform("e", lambda x: F.floor(F.lit(scale) * x).cast("int")).alias("e"))


def placed(whole: DataFrame, pivots: Pivots, is_query: Column) -> DataFrame:
    """(d, pivot, away, most, vec_id, e, query, candidate): each vector with its pivot.

    Of equal vectors in a batch only the k + 1 smallest ids are candidates: no query's k best has more. Repeats of a row go.
    """
    sent = whole.sparkSession.sparkContext.broadcast(pivots)
    schema = pa.schema([("d", pa.int32()), ("pivot", pa.int32()), ("away", pa.float64()), ("most", pa.float64()), ("vec_id", pa.int64()), ("e", pa.list_(pa.int32())), ("query", pa.bool_()), ("candidate", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asks = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for at, x in vectors_of(batch.column(1)):
                by = np.lexsort((ids[at], *x.T)) if x.shape[1] else np.argsort(ids[at], kind="stable")
                at, x = at[by], x[by]
                same = np.concatenate([[False], (x[1:] == x[:-1]).all(1)])
                once = ~(same & np.concatenate([[False], ids[at][1:] == ids[at][:-1]]))
                at, x, same = at[once], x[once], same[once]
                group = np.cumsum(~same)
                nth = np.arange(len(at)) - np.searchsorted(group, group)
                few = nth <= sent.value.k
                keep = few | asks[at]
                at, x, few = at[keep], x[keep], few[keep]
                pivot, away = sent.value.nearest(x)
                e = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(pivot.astype(np.int32)), pa.array(away), pa.array((x**2).sum(1)), pa.array(ids[at]), e, pa.array(asks[at]), pa.array(few)], schema=schema)

    return whole.select("vec_id", "e", is_query.alias("query")).mapInArrow(run, "d int, pivot int, away double, most double, vec_id long, e array<int>, query boolean, candidate boolean")


def asked(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """(d, pivot, near, vec_id, e, floor): each query for every pivot that its bound reaches; near is its own pivot."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    schema = pa.schema([("d", pa.int32()), ("pivot", pa.int32()), ("near", pa.int32()), ("vec_id", pa.int64()), ("e", pa.list_(pa.int32())), ("floor", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, near = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, x in vectors_of(batch.column(2)):
                floor = sent.value.floors(x, ids[at])
                reached = sent.value.shelves(x, floor)
                for a in range(0, len(at), 256):  # a few queries' rows at a time
                    size = [len(r) for r in reached[a : a + 256]]
                    which = np.repeat(np.arange(a, a + len(size)), size)
                    e = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1) * x.shape[1], pa.int32()), pa.array(x[which].astype(np.int32).ravel()))
                    pivot = np.concatenate(reached[a : a + 256]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), x.shape[1], np.int32)), pa.array(pivot), pa.array(near[at][which]), pa.array(ids[at][which]), e, pa.array(floor[which])], schema=schema)

    return rows.select("vec_id", "pivot", "e").mapInArrow(run, "d int, pivot int, near int, vec_id long, e array<int>, floor double")


def shelf_search(met: DataFrame, k: int) -> DataFrame:
    """(query_id, content, vec_id, score): the k best of each shelf for each query that came to it.

    A shelf's candidates come first, then its queries, near ones together; queries are searched in groups as they come.
    """
    schema = pa.schema([("query_id", pa.int64()), ("content", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def answered(search: Search | None, asks: list[tuple]) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], [], []]
        ids, content, floor, x = (np.concatenate(c) for c in zip(*asks))
        for a in range(0, len(ids) if search else 0, GROUP):
            s = slice(a, a + GROUP)
            for query_id, c, (score, found) in zip(ids[s], content[s], search.best(x[s], ids[s], floor[s])):
                for column, v in zip(out, (np.full(len(found), query_id), np.full(len(found), c), found, score)):
                    column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, held, asks, search = None, [], [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
            asking, ids, content, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5, 6))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if shelf != (now := tuple(key[a])):
                    if asks:
                        yield answered(search, asks)
                    shelf, held, asks, search = now, [], [], None
                x = batch.column(7).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                q = asking[a:b]
                if not q.all():
                    held.append((ids[a:b][~q], x[~q]))
                if q.any():
                    if search is None and held:
                        search = Search(np.concatenate([v for _, v in held]), np.concatenate([i for i, _ in held]), k)
                        held = []
                    asks.append((ids[a:b][q], content[a:b][q], floor[a:b][q], x[q]))
                    if sum(len(i) for i, *_ in asks) >= GROUP:
                        yield answered(search, asks)
                        asks = []
        if asks:
            yield answered(search, asks)

    return met.mapInArrow(run, "query_id long, content long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column | None = None, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` vectors of highest integer product, of all other ids.

    A component x of ``vectors`` (vec_id, embedding) counts as floor(scale * x). Queries are the rows where ``is_query``
    (default: vec_id divisible by 50) holds, candidates all rows with another vec_id and a vector of the same length; equal
    scores are ranked by vec_id. Rows that repeat vec_id and vector are one; a vec_id with two vectors is two
    candidates and, as queries, two with ranks each. A null vec_id or vector, null or non-finite components take no part,
    nor do vectors whose squared scaled length is 2**60 or more, for which 64 bits may not hold a score. Empty vectors score
    0 with each other. An empty table gives an empty result. Other columns are neither read nor returned.

    SAMPLE bounds the sample that pivots are made from; it decides how much is pruned, never the result.
    """
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = scaled(vectors, scale)
    drawn = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    pivots = Pivots([(r["vec_id"], r["e"]) for r in drawn], k)
    rows = written(placed(whole, pivots, F.col("vec_id") % 50 == 0 if is_query is None else is_query), "placed")
    reach = rows.where("candidate").groupBy("d", "pivot").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max("most").alias("most")).collect()  # PIVOTS rows for each length
    for d in {r["d"] for r in reach}:
        own = [r for r in reach if r["d"] == d]
        pivots.reach[d] = tuple(np.array([r[c] for r in own]) for c in ("pivot", "away", "most"))
    tiles = rows.sparkSession.createDataFrame([(r["d"], r["pivot"], max(1, -(-r["n"] * max(r["d"], 1) // TILE))) for r in reach], "d int, pivot int, tiles int")

    content = F.xxhash64("e")
    held = rows.where("candidate").join(F.broadcast(tiles), ["d", "pivot"]).select("d", "pivot", F.pmod(F.xxhash64("vec_id", "e"), F.col("tiles")).cast("int").alias("tile"), F.lit(False).alias("asking"), "vec_id", content.alias("content"), F.lit(None).cast("double").alias("floor"), "e", F.lit(-1).alias("near"))
    once = rows.where("query").groupBy("vec_id", "e").agg(F.first("pivot").alias("pivot"))
    queries = asked(once, pivots).join(F.broadcast(tiles), ["d", "pivot"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = held.unionByName(queries.select("d", "pivot", "tile", F.lit(True).alias("asking"), "vec_id", content.alias("content"), "floor", "e", "near"))
    dealt = met.repartition(n, "d", "pivot", "tile").sortWithinPartitions("d", "pivot", "tile", "asking", "near").select("d", "pivot", "tile", "asking", "vec_id", "content", "floor", "e")
    first = Window.partitionBy("query_id", "content").orderBy(F.desc("score"), "vec_id")
    ranked = shelf_search(dealt, k).withColumn("rank", F.row_number().over(first).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
