"""Models asked once, the sized cache with restarts, and runs that are stopped and go on."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from gridproof.operators import ledger, scans
from gridproof.streaming.cache import cached_lookups


def counting(folder, model):
    """A model that leaves a file for each row that it is asked about."""

    def load():
        def asked(names, *more):
            for n in names:
                with open(os.path.join(folder, n), "a") as f:
                    f.write("x")
            return model(names, *more)

        return asked

    return load


def calls(folder):
    return {os.path.basename(p): os.path.getsize(p) for p in glob.glob(f"{folder}/*")}


NAMES = [f"n{i}" for i in range(10)]


def test_models_are_asked_once_under_filters(spark, tmp_path):
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "name string, i int").repartition(2)
    found = scans.watermark_batch(rows, counting(tmp_path, lambda names: [[0.0, float(n[1:])] for n in names]), "name")
    assert found.where("watermark_status <> 'pass' AND has_watermark").count() > 0
    assert calls(tmp_path) == dict.fromkeys(NAMES, 1)


def test_recognisers_are_asked_once(spark, tmp_path):
    rows = spark.createDataFrame([(n,) for n in NAMES], "image string")
    said = [{"text": "Summer sale", "confidence": 0.9, "detection": 0.9, "recognition": 0.9, "w": 30, "h": 9}]
    got = scans.text_batch(rows, counting(tmp_path, lambda names: [None if n == "n3" else said * int(n[1:]) for n in names]), "image").collect()
    assert {r.image: r.n_texts for r in got} == {n: 0 if n == "n3" else int(n[1:]) for n in NAMES} and [r.image for r in got if r.status == "error"] == ["n3"]
    assert calls(tmp_path) == dict.fromkeys(NAMES, 1)


def test_written_answers_under_joins_and_filters(spark, tmp_path):
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "name string, i int").repartition(3)
    answers = scans.scored_once(rows, "score", counting(tmp_path, lambda names, i: [float(x) for x in i]), "name", "i", key="name")
    both = rows.join(answers.where("score > 3"), "name").unionByName(rows.join(answers.where("score < 2"), "name"))
    assert sorted(r.score for r in both.collect()) == [0.0, 1.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    assert calls(tmp_path) == dict.fromkeys(NAMES, 1)


def test_batches_by_size(spark):
    assert scans.by_weight([5, 1, None, 9, 4, 30], 10) == [[2, 1, 4, 0], [3], [5]]
    assert scans.by_weight([], 10) == []
    rows = spark.createDataFrame([(n, (i * 7) % 10) for i, n in enumerate(NAMES)], "name string, pixels int").coalesce(1)
    got = scans.with_scorer(rows, "seen", lambda: lambda names: [len(names)] * len(names), "name", kind="int", weight=F.col("pixels"), most=9).collect()
    assert {r.name: r.seen for r in got if r.pixels in (0, 1, 2, 3)} == {n: 4 for n, p in [(f"n{i}", (i * 7) % 10) for i in range(10)] if p < 4}
    assert all(r.seen == 1 for r in got if r.pixels >= 6)


LOOKUPS = "cache string, path string, ts timestamp"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def by_loop(batches, size, ttl):
    held, out = {}, []
    for batch in batches:
        for cache, path, ts in sorted(batch, key=lambda r: (r[2], r[1])):
            own = held.setdefault(cache, {})
            gone = [p for p, t in own.items() if (ts - t).total_seconds() > ttl]
            for p in gone:
                del own[p]
            n, hit = len(gone), path in own
            if not hit:
                own[path] = ts
                while len(own) > size:
                    del own[min(own, key=lambda p: (own[p], p))]
                    n += 1
            out.append((cache, path, ts, hit, n))
    return sorted(out)


def test_cache_is_bounded_in_age_and_size_and_survives_a_restart(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [
        [("a", f"p{i}", at(i)) for i in range(5)] + [("b", "p0", at(3))],  # two more than fit
        [("a", "p4", at(6)), ("a", "p0", at(7)), ("b", "p0", at(8))],  # hit, evicted before, hit
        [("a", "p4", at(290)), ("a", "p3", at(305)), ("a", "p0", at(306))],  # p3 has aged, p0 and p4 are there still
        [("b", "p0", at(900)), ("a", "p0", at(901)), ("a", "p9", at(902))],
    ]
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    try:
        for i, batch in enumerate(batches):  # each batch is a run of its own, from the checkpoint of the one before
            spark.createDataFrame(batch, LOOKUPS).coalesce(1).write.mode("append").parquet(source)
            stream = cached_lookups(spark.readStream.schema(LOOKUPS).parquet(source), size=3, ttl_seconds=300)
            stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", sink).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted((r.cache, r.path, r.ts, r.hit, r.evicted) for r in spark.read.parquet(sink).collect())
    assert [g[:4] for g in got] == [w[:4] for w in by_loop(batches, 3, 300)]


TRIES = {"n1": ["CUDA out of memory", None], "n2": ["bad channel order", "weights missing", None], "n3": ["odd"] * 9, "n4": ["no such file", "no such file", None]}


def strategies(folder, fail_in=None):
    def make(name):
        def ask(rows):
            def work(batches):
                for b in batches:
                    values, errors = [], []
                    for n in b["name"]:
                        with open(os.path.join(folder, f"{n}-{name}"), "a") as f:
                            f.write("x")
                        nth = sum(1 for s in os.listdir(folder) if s.startswith(f"{n}-")) - 1
                        told = TRIES.get(n, [None])
                        e = told[min(nth, len(told) - 1)]
                        values.append(None if e else f"{name}:{n}")
                        errors.append(e)
                    if fail_in == name:
                        raise RuntimeError("stopped")
                    yield b[["name"]].assign(value=values, error=errors)

            return rows.select("name").mapInPandas(work, "name string, value string, error string")

        return ask

    return {n: make(n) for n in ("plain", "smaller", "other_channels", "other_model", "fallback")}


def test_a_stopped_run_goes_on_from_its_ledger(spark, tmp_path):
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string").coalesce(1)
    seen = [str(tmp_path / x) for x in ("seen-whole", "seen-broken")]
    for s in seen:
        os.mkdir(s)
    whole = ledger.run_with_ledger(rows, "name", strategies(seen[0]), "plain", str(tmp_path / "whole"), rounds=6)
    want = sorted((tuple(r) for r in whole.collect()), key=repr)
    last = {r.name: r for r in ledger.outcome(whole, "name").collect()}
    assert last["n0"].value == "plain:n0" and last["n0"].n_tries == 1
    assert last["n1"].value == "smaller:n1" and last["n2"].value == "other_model:n2"
    assert last["n3"].value is None and last["n3"].error == "odd" and last["n3"].n_tries == 5  # every strategy once
    assert last["n4"].n_tries == 1 and last["n4"].fallback.status == "fail" and last["n4"].fallback.reason == "Image file corrupted or unreadable: no such file"
    assert last["n3"].fallback.status == "pass" and last["n3"].fallback.reason == "Processing error: odd" and last["n0"].fallback is None
    with pytest.raises(Exception, match="stopped"):
        ledger.run_with_ledger(rows, "name", strategies(seen[1], "other_model"), "plain", str(tmp_path / "broken"), rounds=6).collect()
    for p in glob.glob(f"{seen[1]}/*-other_model"):
        os.remove(p)
    again = ledger.run_with_ledger(rows, "name", strategies(seen[1]), "plain", str(tmp_path / "broken"), rounds=6)
    assert sorted((tuple(r) for r in again.collect()), key=repr) == want
    assert calls(seen[1])["n0-plain"] == 1  # rounds that were written are not asked again
    assert ledger.run_with_ledger(rows.limit(0), "name", strategies(seen[0]), "plain", str(tmp_path / "none")).collect() == []
