"""Resampling against plain loops on odd sizes; strips by running sums against strips added up."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridproof.functions import sizes
from gridproof.operators import kernels, pictures, resample


def area_by_loops(x, n):
    m, step = len(x), len(x) / n
    return [sum(x[j] * max(0.0, min((i + 1) * step, j + 1) - max(i * step, j)) for j in range(m)) / step for i in range(n)]


def cubic_by_loops(x, n):
    def weight(d):
        d, a = abs(d), -0.75
        return (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a if d < 2 else 0.0

    out = []
    for i in range(n):
        at = (i + 0.5) * len(x) / n - 0.5
        out.append(sum(weight(at - j) * x[min(max(j, 0), len(x) - 1)] for j in range(math.floor(at) - 1, math.floor(at) + 3)))
    return out


@pytest.mark.parametrize("m, n", [(7, 3), (64, 40), (5, 5), (101, 1), (13, 12)])
def test_areas(m, n):
    x = np.random.default_rng(m).integers(0, 256, m)
    assert resample.by_area(x, n) == pytest.approx(area_by_loops(x.tolist(), n))


@pytest.mark.parametrize("m, n", [(7, 19), (1, 4), (2, 3), (64, 100), (33, 34)])
def test_cubic(m, n):
    x = np.random.default_rng(m).integers(0, 256, m)
    assert resample.by_cubic(x, n) == pytest.approx(cubic_by_loops(x.tolist(), n))


def plane(w, h, seed, channels=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, channels) if channels > 1 else (h, w), dtype=np.uint8)


def by_loops(p, w, h):
    way = area_by_loops if w <= p.shape[1] and h <= p.shape[0] else cubic_by_loops
    rows = np.array([way(c, h) for c in p.T.astype(float).tolist()]).T
    out = np.array([way(r, w) for r in rows.tolist()])
    return np.clip(np.floor(out + 0.5 + 1e-9), 0, 255).astype(np.uint8)


def test_pictures_as_a_recogniser_gets_them(spark):
    sizes = [(37, 23), (400, 11), (9, 300), (3100, 40), (5, 5)]
    rows = [(i, w, h, plane(w, h, i).tobytes(), None, f"p{i}") for i, (w, h) in enumerate(sizes)]
    rows += [(10, 4, 4, b"short", None, "bad"), (11, 3, 3, None, None, "none"), (12, None, 5, b"", None, "no width")]
    table = spark.createDataFrame(rows, "image int, width int, height int, gray binary, rgb binary, v string")
    got = {r.image: r for r in resample.for_text(table).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 10, 11, 12} and got[0].v == "p0"
    for i, (w, h) in enumerate(sizes):
        x, y, cw, ch = max(0, (w - h * 20) // 2), max(0, (h - w * 20) // 2), min(w, h * 20), min(h, w * 20)
        p = plane(w, h, i)[y : y + ch, x : x + cw]
        f = max(min(1.0, 3000 / max(w, h)), 20 / min(w, h) if min(w, h) < 20 else 0)
        wide, high = int(cw * f), int(ch * f)
        assert got[i].text_ok == (min(wide, high) >= 20 and max(wide, high) <= 3000)
        if got[i].text_ok:
            assert (got[i].width, got[i].height) == (wide, high)
            assert (np.frombuffer(got[i].gray, np.uint8).reshape(high, wide) == by_loops(p, wide, high)).all()
        else:
            assert got[i].gray is None
    assert all(got[i].gray is None for i in (10, 11, 12))
    assert resample.for_text(table.limit(0)).collect() == []


def test_colours_and_hard_pictures(spark):
    p = plane(30, 2100, 3, channels=3)
    table = spark.createDataFrame([(1, 30, 2100, p[:, :, 0].tobytes(), p.tobytes())], "image int, width int, height int, gray binary, rgb binary")
    r = resample.for_hard_pictures(table).first()
    first = by_loops(p[:, :, 1], int(30 * 2000 / 2100), 2000)
    f = 32 / min(first.shape)
    want = by_loops(first, int(first.shape[1] * f), int(first.shape[0] * f))
    assert (r.height, r.width) == want.shape
    assert (np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)[:, :, 1] == want).all()
    small = resample.resampled(table, F.struct(F.lit(10).alias("width"), F.lit(0).alias("height"))).first()
    assert small.gray is None and small.rgb is None


def test_sides_without_pixels_have_no_size(spark):
    sized = spark.createDataFrame([(4200, 1), (1, 4200), (0, 5), (3000, 0), (4200, 40)], "width int, height int")
    w, h = F.col("width"), F.col("height")
    rules = {"text": sizes.for_text(w, h), "hard": sizes.for_hard_pictures(w, h), "clip": sizes.for_clip(w, h), "input": sizes.text_input(w, h, F.lit(3))}
    got = {(r.width, r.height): r for r in sized.select("*", *[c.alias(n) for n, c in rules.items()]).collect()}
    assert tuple(got[4200, 1].text) == (2000, 0) and tuple(got[4200, 1].hard) == tuple(got[1, 4200].hard) == (None, None) == tuple(got[0, 5].hard)
    assert tuple(got[4200, 40].hard) == (3368, 32) and tuple(got[4200, 1].clip) == (2048, 0) and not got[3000, 0].input.ok
    bytes_ = spark.createDataFrame([(4200, 1, bytes(4200))], "width int, height int, gray binary")
    assert resample.for_hard_pictures(bytes_).first().gray is None


def test_sums_of_bytes(spark):
    p = plane(7, 5, 2)
    t = spark.createDataFrame([(1, 7, p.tobytes()), (2, 7, None), (3, 7, b"12345678"), (4, None, b"1")], "image int, width int, gray binary")
    found = t.select("image", resample.sums("width", "gray").alias("v"))
    got = {r.image: r.v for r in found.collect()}
    g = p.astype(int)
    assert tuple(got[1]) == (g.sum(), (g * np.arange(1, 8)).sum(), (g * np.arange(1, 6)[:, None]).sum()) and got[2] is got[3] is got[4] is None
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_running_sums_give_the_same_boxes():
    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 256, (37, 53), dtype=np.int32), rng.random((20, 31))):
        sums = pictures.Sums(values)
        for _ in range(60):
            y0, y1, x0, x1 = (int(v) for v in rng.integers(-5, 60, 4))
            part = values[max(y0, 0) : max(y1, 0), max(x0, 0) : max(x1, 0)].astype(float)
            assert sums.box(y0, y1, x0, x1) == pytest.approx((part.size, part.sum(), (part * part).sum()), abs=1e-8)
    g = rng.integers(0, 256, (83, 67), dtype=np.int32)
    assert pictures.Sums(g).cells(8) == pytest.approx(g[:80, :64].reshape(8, 10, 8, 8).std(axis=(1, 3)))


def test_kernels_by_rows_and_columns():
    rng = np.random.default_rng(5)
    g = rng.integers(0, 256, (31, 44), dtype=np.int32)
    p = np.pad(g, 1, mode="reflect").astype(float)
    box = [[p[i : i + 31, j : j + 44] for j in range(3)] for i in range(3)]
    assert (kernels.high_pass(g) == 9 * box[1][1] - sum(map(sum, box))).all()
    assert (kernels.laplacian(g) == box[0][1] + box[2][1] + box[1][0] + box[1][2] - 4 * box[1][1]).all()
    q = np.pad(g, 1, mode="edge")
    assert (kernels.median3(g) == np.median([q[i : i + 31, j : j + 44] for i in range(3) for j in range(3)], axis=0)).all()
    for shape in ((31, 44), (32, 45), (30, 42)):
        x = rng.integers(0, 256, shape)
        mag = np.abs(np.fft.fftshift(np.fft.fft2(x)))
        y, z = np.ogrid[: shape[0], : shape[1]]
        r, far = np.hypot(z - shape[1] // 2, y - shape[0] // 2), min(shape) // 2
        got = kernels.frequency_features(x)
        assert got["low_freq"] == pytest.approx((mag**2)[r <= 0.3 * far].sum() / (mag**2).sum())
        assert got["frequency_variance"] == pytest.approx(np.log(mag + 1).var()) and got["total_energy"] == pytest.approx((mag**2).sum())


def test_cost_of_a_large_picture():
    """A picture of 1500 by 1000: sums and kernels in well under the 2.6 seconds of separate strips and doubles."""
    g = (np.add.outer(np.sin(np.arange(1000) / 37) * 60, np.cos(np.arange(1500) / 53) * 60) + 128 + np.random.default_rng(0).normal(0, 6, (1000, 1500))).clip(0, 255).astype(np.int32)
    begun = time.process_time()
    pictures.measures(g, None, ("hist", "rims", "even", "blocks", "shade", "sides", "slope", "kernels"))
    assert time.process_time() - begun < 1.5
