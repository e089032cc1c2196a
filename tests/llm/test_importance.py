"""Importance resampling against plain Python, over the tables and over odd rows."""

import hashlib
import math
import os
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from gridproof.llm import importance, queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def buckets(text):
    words = WORDS.findall((text or "").encode().lower())  # bytes.lower changes A-Z only
    runs = [b" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return Counter(crc32(r) % 10_000 for r in runs), len(words)


def brute(docs, target, percent=5, min_words=20):
    s, t, each = Counter(), Counter(), []
    for doc_id, text in docs:
        got, n = buckets(text)
        s.update(got)
        each.append((doc_id, got, n))
    for text in target:
        t.update(buckets(text)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, got, n in each:
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in got.items())
        rows.append([doc_id, sum(got.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return [(r[0], r[1], r[2], r[3], r[5]) for r in rows]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_tables_as_brute_force(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert rows_of(queries.QUERIES["op12_resampling"](spark, SF)) == sorted(brute(docs, target), key=repr)


ODD = [(1, None), (2, ""), (3, "... !"), (4, "A"), (5, "a b"), (None, "le chat est sur la table " * 9), (6, "x\x00y É中文 Zz9_q"), *[(7, "the cat sat on the mat " * 9)] * 3, (8, "Word wörd " * 30_000), (9, "the dog sat on a mat and so on " * 5)]


def test_odd_rows(spark):
    target = [None, "", "the cat sat", "le CHAT"]
    docs = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in ODD], "doc_id long, text string, rank string, range int, block int")
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, s int")
    got = rows_of(importance.resample(docs.repartition(3), aim, percent=50))
    assert got == sorted(brute(ODD, target, percent=50), key=repr)
    assert sum(r[4] is not None for r in got) == 3
    assert importance.resample(docs.limit(0), aim).collect() == []
    assert rows_of(importance.resample(docs, aim.limit(0))) == sorted(brute(ODD, []), key=repr)


def test_pieces_blocks_and_slices_change_nothing(spark, monkeypatch):
    text = "One two, three four five six seven eight nine ten. " * 40
    whole = sum((Counter(p.tolist()) for p in importance.feature_buckets(text.encode())[0]), Counter())
    for size in (1, 7, 100):
        monkeypatch.setattr(importance, "PIECE", size)
        parts, n = importance.feature_buckets(text.encode())
        assert sum((Counter(p.tolist()) for p in parts), Counter()) == whole == buckets(text)[0] and n == 400
    found = np.array([0, 1, 255, 256, 2**31, 2**32 - 1])
    assert (importance.numbers(importance.planes(found)) == found).all()
    monkeypatch.setattr(importance, "SLICE", 1)  # on the driver: each block's postings meet the totals in a piece of their own
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} w{i % 3} and more " * 5) for i in range(200)], "doc_id long, text string").repartition(6)
    aim = spark.createDataFrame([("w1 w2 and",)], "text string")
    assert rows_of(importance.resample(docs, aim)) == sorted(brute([tuple(r) for r in docs.collect()], ["w1 w2 and"]), key=repr)
