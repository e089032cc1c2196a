"""Exact top-k search against plain loops: random, clustered and equal vectors, ties and odd rows."""

import math

import numpy as np
import pytest

from gridproof.llm import cover_tree


def brute(rows, k=5, every=50):
    sound = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    sound = list(dict.fromkeys((i, tuple(e)) for i, e in sound))
    out = []
    for i, q in sound:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in sound if j != i and len(e) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, e, 1, 2, "x") for i, e in rows], f"vec_id long, embedding array<{kind}>, d int, pivot int, near string")


@pytest.mark.parametrize("seed, dim, spread", [(1, 3, 1.0), (2, 64, 1.0), (3, 8, 0.05), (4, 16, 0.3)])
def test_as_brute_force(spark, monkeypatch, seed, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    x = centres[rng.integers(0, 6, 700)] + spread * rng.standard_normal((700, dim))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    x[::9] = x[4]  # a ninth are one vector
    rows = list(enumerate(np.round(x, 2 if seed == 3 else 6).tolist()))  # coarse ones give ties
    monkeypatch.setattr(cover_tree, "SAMPLE", 40)
    monkeypatch.setattr(cover_tree, "TILE", 64 * dim)
    assert rows_of(cover_tree.top_k(table(spark, rows).repartition(3))) == brute(rows)


def test_odd_rows(spark):
    e = [0.5, -0.25, 1.0]
    rows = [(0, e), (0, e), (0, [1.0, 1.0, 1.0]), (50, None), (100, [0.1, None, 0.2]), (150, [float("nan"), 0.0, 0.0]), (200, [float("inf"), 0.0, 0.0]), (-50, [-0.001, 0.0, 0.0])]
    rows += [(250, []), (251, []), (300, [2.0]), (301, [3.0]), (None, e), (1, e), (2, e), (3, [0.0, 0.0, 0.0]), (4, [1.0, 2.0, 3.0]), (400, [1000.0, -1000.0, 12345.678]), (5, [99999.0, 4.0, 5.0])]
    got = rows_of(cover_tree.top_k(table(spark, rows)))
    assert got == brute(rows)
    assert cover_tree.top_k(table(spark, [])).collect() == []
    assert cover_tree.top_k(table(spark, [(0, e)])).collect() == []
    huge = [(0, [1e300, 1.0]), (1, [1.0, 1.0]), (50, [1e6, 1e6]), (51, [1e6, -1e6])]
    assert rows_of(cover_tree.top_k(table(spark, huge))) == brute(huge[1:])
    single = [(i, np.float32([i / 7, 1 / 3]).tolist()) for i in range(60)]
    assert rows_of(cover_tree.top_k(table(spark, single, "float"))) == brute(single)


def test_net_is_a_cover_tree_level():
    x = np.random.default_rng(1).standard_normal((500, 4))
    centres, owner, away = cover_tree.farthest_first(x, 20, 0, False)
    apart = np.sqrt(((x[centres][:, None] - x[centres][None]) ** 2).sum(-1)) + 1e9 * np.eye(len(centres))
    assert apart.min() >= away.max() and np.allclose(away, np.sqrt(((x - x[centres][owner]) ** 2).sum(1)))
    tree = cover_tree.CoverTree(x)
    for i in range(len(tree.radius)):
        own = x[tree.order[tree.start[i] : tree.end[i]]]
        assert np.sqrt(((own - tree.centre[i]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-9
        if tree.child[i] < tree.child_end[i]:
            assert tree.start[tree.child[i]] == tree.start[i] and tree.end[tree.child_end[i] - 1] == tree.end[i]


def test_pairs_are_pruned(monkeypatch):
    """Of clustered vectors few are scored."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 8))
    x = centres[rng.integers(0, 40, 8000)] + 0.02 * rng.standard_normal((8000, 8))
    x = np.floor(256 * x / np.sqrt((x**2).sum(1, keepdims=True)))
    search, scored = cover_tree.Search(x, np.arange(8000), 5), []
    score = search.score
    monkeypatch.setattr(search, "score", lambda rows, points: (scored.append(len(rows) * len(points)), score(rows, points)))
    own = np.arange(0, 8000, 50)
    got = search.best(x[own], own, np.full(len(own), -np.inf))
    s = (x[own] @ x.T).astype(int)
    s[np.arange(len(own)), own] = -(10**9)
    assert all((found[0] == np.sort(row)[::-1][:5]).all() for found, row in zip(got, s))
    assert sum(scored) < 0.35 * len(own) * 8000
