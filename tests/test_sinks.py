"""Sinks, step numbers, modes and scorers with several attempts."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridproof.operators import summaries, verdicts
from gridproof.sources import reports


def lines(path):
    return [x for f in sorted(Path(path).glob("part-*")) for x in f.read_text().splitlines()]


def test_results_keep_the_last_of_a_name_and_replace_earlier_output(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", 1, 0.5), ("a.png", 2, 0.7), ("b.png", 1, 0.1)], "filename string, nth int, score double")
    for table in (rows.limit(1), rows):
        reports.write_results(table, str(tmp_path / "r"))
    assert sorted((json.loads(x)["filename"], json.loads(x)["score"]) for x in lines(tmp_path / "r")) == [("a.png", 0.7), ("b.png", 0.1)]
    reports.write_report(rows, str(tmp_path / "j"))
    assert len(lines(tmp_path / "j")) == 3


def test_report_lines_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", "valid", None), ("a", "valid", None), ("c", "odd", "Failed checks: x: 1; y: 2"), ("d", "manual_review", "text: 3")], "filename string, category string, reason string")
    reports.write_lines(summaries.report_lines(rows), str(tmp_path / "t"), order=["section", "filename", "nth"])
    assert lines(tmp_path / "t") == ["+ a", "+ b", "x c: Failed checks:", "   1] x: 1", "   2] y: 2", "? d: text: 3"]


def test_flags_are_appended_and_logs_prefixed(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",)], "filename string")
    reports.write_flags(rows, str(tmp_path / "f"))
    reports.write_flags(rows.limit(1), str(tmp_path / "f"))
    assert len(lines(tmp_path / "f")) == 3
    reports.copy_log(rows, str(tmp_path / "l"), "borders", "filename")
    assert sorted(lines(tmp_path / "l")) == ["[borders] a", "[borders] b"]


def test_step_numbers():
    steps = ["a", "b", "c", "d"]
    assert verdicts.step_numbers("4, 2,4", steps) == ["b", "d"]
    for bad in ("", "0", "5", "x", "1;2"):
        with pytest.raises(ValueError):
            verdicts.step_numbers(bad, steps)


def test_a_failed_gate_is_all_there_is(spark):
    v = spark.createDataFrame([(1, "specs", 1, "pass", 0.0), (1, "text", 2, "error", 0.0), (2, "specs", 1, "manual", 0.0), (3, "specs", 1, "error", 0.0)], "k int, test string, test_ord int, status string, score double")
    gate = spark.createDataFrame([(1, "ok"), (2, "file_too_small"), (3, "ok"), (4, "ok")], "k int, code string")
    got = {m: {r.k: (r.category, r.tests) for r in verdicts.by_mode(v, gate, ["k"], m).collect()} for m in verdicts.MODES}
    want = {1: ("valid", ""), 2: ("invalid", "basic_validation"), 3: ("invalid", "specs"), 4: ("valid", "")}
    assert got == {m: want for m in verdicts.MODES}
    with pytest.raises(ValueError):
        verdicts.by_mode(v, gate, ["k"], "odd")
    assert verdicts.by_mode(v.limit(0), gate.limit(0), ["k"], "parallel").count() == 0


def test_missing_predictions_and_sources(spark):
    paths = spark.createDataFrame([("a",), ("b",)], "path string")
    found = summaries.back_to_paths(paths, spark.createDataFrame([("b", 0.5)], "path string, score double"))
    both = summaries.with_errors(found, spark.createDataFrame([("z", "missing file")], "path string, error string"))
    assert {r.path: (r.score, r.error, r.exists) for r in summaries.without_source(both, paths, "path").collect()} == {"a": (None, "no result", True), "b": (0.5, None, True), "z": (None, "missing file", False)}
    assert summaries.hit_rate(paths.limit(0).withColumn("hit", F.lit(True))).first().hit_rate == 0
