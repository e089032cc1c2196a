"""What a task holds at a time, and what a rule costs a picture, do not grow with the tables."""

import os

import numpy as np
import pyarrow as pa
import pytest

from gridproof.operators import pictures, scans
from gridproof.plans import catalog, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("colour", [True, False])
def test_pictures_are_drawn_in_small_batches(colour):
    vectors = pa.RecordBatch.from_pylist([{"image": i, "u": [0.5] * 64} for i in range(1000)])
    made = list(views.drawn(iter([vectors, vectors.slice(0, 0)]), colour))
    assert sum((b["image"].to_pylist() for b in made), []) == list(range(1000))
    assert max(b.num_rows for b in made) <= views.DRAWN and max(b.nbytes for b in made) < 5 << 20
    assert ("rgb" in made[0].schema.names) == colour


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_rules_take_no_sum_again_for_each_level(spark):
    for name in ("fallback_editing", "unified_plain", "routine_plain"):  # entropies in the plan were sums of sums, for each use
        assert "aggregate(" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "rgb" not in catalog.QUERIES["border_scan"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_plain_parts_as_the_whole_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(i, w, h, rng.integers(0, 256, h * w, dtype=np.uint8).tobytes(), rng.integers(0, 30, 3 * h * w, dtype=np.uint8).tobytes()) for i, (w, h) in enumerate(((3, 3), (64, 40), (501, 7)))] + [(9, 3, 3, bytes(9), None)]
    t = spark.createDataFrame(rows, "image int, width int, height int, gray binary, rgb binary")
    found = [c.alias(n) for n, c in (("e", pictures.edge_strips()), ("f", pictures.fallback_editing()))]
    few, all_, both = (pictures.measured(t, *parts).select("image", *found).orderBy("image").collect() for parts in (("edge", "levels"), ("rims", "colour"), ("rims", "edge", "colour", "levels")))
    assert few == all_ == both and few[3].f.entropy is None
    assert {r.status for r in scans.unified(t, ["borders", "editing"], plain=("borders", "editing")).collect()} <= {"pass", "fail"}
