"""Parts of masks by joins against a flood fill, whole and cut into tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridproof.operators import components


def flood(mask, corners=True):
    h, w = mask.shape
    seen, out = np.zeros(mask.shape, bool), []
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (corners or not (dy and dx))]
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            todo, own = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                own.append((a, b))
                for dy, dx in around:
                    c, d = a + dy, b + dx
                    if 0 <= c < h and 0 <= d < w and mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
            ys, xs = zip(*own)
            out.append((len(own), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    return [(i, *o) for i, o in enumerate(out, 1)]


def masks():
    rng = np.random.default_rng(7)
    noise = rng.random((40, 150)) < 0.35
    spiral = np.zeros((40, 150), bool)
    for k in range(0, 18, 2):
        spiral[k, k : 150 - k] = spiral[39 - k, max(k - 2, 0) : 150 - k] = spiral[k : 40 - k, 149 - k] = spiral[k + 2 : 40 - k, k] = True
    return [noise, spiral, np.zeros((40, 150), bool), np.ones((40, 150), bool), np.eye(40, 150, dtype=bool)]


TILES = "image int, left int, top int, width int, height int, gray binary, y string"


@pytest.mark.parametrize("cuts", [([0, 150], [0, 40]), ([0, 1, 63, 64, 130, 150], [0, 17, 18, 40])])
@pytest.mark.parametrize("corners", [True, False])
def test_parts_as_a_flood_fill(spark, cuts, corners):
    rows, want = [], []
    for i, m in enumerate(masks()):
        g = (m * 255).astype(np.uint8)
        for x0, x1 in zip(cuts[0], cuts[0][1:]):
            rows += [(i, x0, y0, x1 - x0, y1 - y0, g[y0:y1, x0:x1].tobytes(), "x") for y0, y1 in zip(cuts[1], cuts[1][1:])]
        want += [(i, *p) for p in flood(m, corners)]
    rows += [(90, 0, 0, 3, 3, None, "x"), (91, 0, 0, 3, 3, b"short", "x"), (92, 0, 0, None, 3, b"", "x"), (None, 0, 0, 2, 2, b"\xff\0\0\xff", "x")]
    want += [(None, 1, 2, 0, 0, 2, 2)] if corners else [(None, 1, 1, 0, 0, 1, 1), (None, 2, 1, 1, 1, 1, 1)]
    runs = components.mask_runs(spark.createDataFrame(rows, TILES), lambda g: g >= 128)
    got = [tuple(r) for r in components.mask_components(runs, corners=corners).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("corners", [True, False])
def test_tiles_as_a_flood_fill(spark, corners):
    """Parts within tiles, and links at their edges only: no node for each run, and none for what stays within its tile."""
    rows, want, cuts = [], [], ([0, 1, 63, 64, 130, 150], [0, 17, 18, 40])
    for i, m in enumerate(masks()):
        g = (m * 255).astype(np.uint8)
        for x0, x1 in zip(cuts[0], cuts[0][1:]):
            rows += [(i, x0, y0, x1 - x0, y1 - y0, g[y0:y1, x0:x1].tobytes(), "x") for y0, y1 in zip(cuts[1], cuts[1][1:])]
        want += [(i, *p) for p in flood(m, corners)]
    rows += [(90, 0, 0, 3, 3, None, "x"), (91, 0, 0, 3, 3, b"short", "x"), (92, 0, 0, None, 3, b"", "x"), (None, 0, 0, 2, 2, b"\xff\0\0\xff", "x")]
    want += [(None, 1, 2, 0, 0, 2, 2)] if corners else [(None, 1, 1, 0, 0, 1, 1), (None, 2, 1, 1, 1, 1, 1)]
    table = spark.createDataFrame(rows, TILES)
    got = [tuple(r) for r in components.tile_components(table, lambda g: g >= 128, corners=corners).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    whole = spark.createDataFrame([(0, 150, 40, (masks()[0] * 255).astype(np.uint8).tobytes())], "image int, width int, height int, gray binary")
    parts = components.tile_parts(whole, lambda g: g >= 128, corners=corners).withColumn("id", F.monotonically_increasing_id())
    assert parts.count() == len(flood(masks()[0], corners)) < components.mask_runs(whole, lambda g: g >= 128).count()
    assert components.run_links(parts.select("id", "image", F.inline("rim")), corners=corners).where("a <> b").count() == 0


def test_frames_among_parts(spark):
    m = np.zeros((60, 100), bool)
    m[5:55, 10:90] = True
    m[8:52, 13:87] = False  # a frame in the middle
    m[20:40, 30:60] = True  # a full block in it
    m[0:2, 0:3] = True  # too small
    table = spark.createDataFrame([(1, 100, 60, (m * 255).astype(np.uint8).tobytes())], "image int, width int, height int, gray binary")
    parts = components.mask_components(components.mask_runs(table, lambda g: g >= 128))
    found = components.frame_candidates(parts, table).orderBy("rank").collect()
    assert [(r.x, r.y, r.width, r.height) for r in found] == [(10, 5, 80, 50), (30, 20, 30, 20)]
    assert found[0].hollow > 0.8 and found[1].hollow == 0 and found[0].score > 0.85
    assert components.mask_components(components.mask_runs(table.limit(0), lambda g: g >= 128)).collect() == []
