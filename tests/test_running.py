"""Running figures by ranges against plain loops."""

from pyspark.sql import functions as F

from gridproof.operators import summaries
from gridproof.operators.running import along
from gridproof.sources.images import slice_scan


def test_prefix_sums_over_ranges(spark):
    rows = [(i * 7 % 101, None if i % 11 == 0 else i, 1) for i in range(101)] + [(None, None, 1)]
    table = spark.createDataFrame(rows, "k int, v int, _at int")
    got = along(table.repartition(5), ["k"], {"so_far": "v"}, ranges=6).orderBy("nth").collect()
    want, total = [], None
    for nth, (k, v, x) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), 1):
        total = v if total is None else total + (v or 0)
        want.append((k, v, x, nth, total))
    assert [tuple(r) for r in got] == want
    assert got[0].asDict().keys() == {"k", "v", "_at", "nth", "so_far"}


def test_prefix_sums_of_equal_rows_and_of_none(spark):
    same = spark.createDataFrame([(1, 2)] * 50, "k int, v int")
    got = along(same, ["k"], {"s": "v"}).orderBy("nth").collect()
    assert [(r["nth"], r["s"]) for r in got] == [(i, 2 * i) for i in range(1, 51)]
    assert along(same.limit(0), ["k"], {"s": "v"}).collect() == []


def test_no_stage_of_one_task(spark):
    table = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    plan = along(table, ["k"], {"s": "v"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the totals, a row for each range


def test_progress_and_slices_of_a_run(spark):
    rows = [(i, float(i % 5) if i % 3 else None) for i in range(1, 48)]
    got = summaries.run_progress(spark.createDataFrame(rows, "i int, took double"), ["i"], "took").orderBy("i").collect()
    assert [r["nth"] for r in got] == [*range(4, 48, 4), 47]
    known = [t for i, t in rows[:4] if t is not None]
    assert got[0]["mean_so_far"] == sum(known) / len(known) and got[0]["left"] == got[0]["mean_so_far"] * 43 and got[-1]["left"] == 0
    files = spark.createDataFrame([(f"f{i:03d}", i) for i in range(60)], "path string, n int")
    assert sorted(r["n"] for r in slice_scan(files, 10, 5).collect()) == [10, 11, 12, 13, 14]
    assert slice_scan(files, 55).count() == 5 and slice_scan(files, 70, 3).count() == 0
