"""Ranked lexical search against plain Python, over random tables, ties and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridproof.llm import lexical_search

TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text):
    return TERMS.findall((text or "").encode().lower())  # bytes.lower changes A-Z only


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for doc_id, c in counted:
            m = 100 - 90 + (90 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


DOC = "doc_id long, text string, rank int, score string, item_id int"


@pytest.mark.parametrize("seed, batch", [(1, 7), (2, 1000), (3, 60)])
def test_random_tables_as_brute_force(spark, seed, batch):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    docs = [(rng.randrange(500), " ".join(rng.choices(words, k=rng.choice([1, 3, 20, 90]))), 1, "x", 2) for _ in range(400)]
    docs += docs[:40]  # equal scores, and equal rows
    items = [(i, " ".join(rng.choices(words + ["none"], k=rng.choice([1, 2, 8, 30])))) for i in range(12)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = rows_of(lexical_search.search(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, "item_id long, text string"), 10))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute([d[:2] for d in docs], items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (None, "The cat"), (4, "the CAT sat"), (4, "the CAT sat"), (5, "é中文 the\x00cat É"), (6, "dog " * 50_000), (-3, "the cat sat"), (7, "unrelated"), (8, "other things entirely"), (9, "more of the same")]
    items = [(1, "the cat"), (1, "the cat"), (2, None), (3, ""), (None, "É dog"), (4, "dog, Dog!"), (4, "sat"), (5, "nothing there")]
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], DOC)
    i = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, doc_id int")
    got = rows_of(lexical_search.search(d, i, 4))
    assert got == brute(docs, [r for r in items if r[1]], 4)
    assert lexical_search.search(d.limit(0), i).collect() == [] and lexical_search.search(d, i.limit(0)).collect() == []


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(j, f"a{j % 5} b{j % 3} c{j}") for j in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(j, f"a{j % 5} c{j}") for j in range(20)], "item_id long, text string")
    whole = rows_of(lexical_search.search(docs, items, 3))
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 40)
    assert rows_of(lexical_search.search(docs, items, 3)) == whole


def test_few_ranges_are_opened(monkeypatch):
    n, w = 4096, 3
    rng = np.random.default_rng(5)
    per_doc = np.full(n, 3)
    terms_, tfs = np.tile(np.arange(3), n).astype(np.int32), np.ones(3 * n, np.int64)
    tfs[3 * 777 : 3 * 777 + 3] = 500  # one document stands out
    sizes = rng.integers(90, 110, n)
    shard = lexical_search.Shard(np.ones(n, bool), np.arange(n), sizes, terms_, tfs, per_doc, np.array([900, 800, 700]), n, int(sizes.sum()))
    pops = []
    pop = lexical_search.heapq.heappop
    monkeypatch.setattr(lexical_search.heapq, "heappop", lambda h: (pops.append(1), pop(h))[1])
    best = shard.search(np.arange(w), [], 1)
    assert best[0][2] == 777 and len(pops) < 40  # of 273 ranges
