"""Whole pictures in one pass: as the form by pixels has them, at several sizes, and from files to verdicts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridproof.functions import scores as sc
from gridproof.operators import contours, kernels, pictures, pixels, scans, verdicts
from gridproof.sources import images

SIZES = [(64, 64), (48, 80), (131, 70)]


def made(w, h, kind, seed=1):
    rng = np.random.default_rng(seed)
    g = rng.integers(40, 160, (h, w))
    y, x = np.mgrid[:h, :w]
    if kind == "framed":
        g[np.minimum(np.minimum(x, y), np.minimum(w - 1 - x, h - 1 - y)) < 4] = 250
    elif kind == "dark":
        g = np.clip(230 - ((x - w / 2) ** 2 + (y - h / 2) ** 2) / 10, 0, 255).astype(int)
    elif kind == "flat":
        g = np.full((h, w), 90)
    return g


def colours(g):
    return np.stack([g, (g * 3 + np.arange(g.shape[1])) % 256, 255 - g], -1).astype(np.uint8)


KINDS = ("noise", "framed", "dark", "flat")


def table(spark, w, h):
    rows = [(k, w, h, made(w, h, k).astype(np.uint8).tobytes(), colours(made(w, h, k)).tobytes()) for k in KINDS]
    return spark.createDataFrame(rows, "image string, width int, height int, gray binary, rgb binary")


def by_pixel(spark, w, h):
    rows = [(k, x, y, int(g[y, x]), *map(int, c[y, x])) for k in KINDS for g in [made(w, h, k)] for c in [colours(g)] for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image string, x int, y int, gray int, r int, g int, b int").cache()


RULES = {
    "obvious_border": pictures.obvious, "simple_border": pictures.simple, "border_region": pictures.region, "uniform_background": pictures.uniform, "block_artifacts": pictures.blockiness, "vignette": pictures.vignetting,
    "edge_strips": pictures.edge_strips, "border_statistics": pictures.statistics, "side_measures": pictures.sides, "border_symmetry": pictures.symmetry, "gradient_ratio": pictures.slope_ratio, "colour_frame": pictures.colour_frame,
}


@pytest.mark.parametrize(("w", "h"), SIZES)
def test_one_pass_agrees_with_pixels(spark, w, h):
    slow = by_pixel(spark, w, h)
    fast = pictures.measured(table(spark, w, h), "hist", "rims", "even", "blocks", "shade", "sides", "slope", "colour").cache()
    for name, rule in RULES.items():
        got = {r.image: r.v.asDict(True) for r in fast.select("image", rule().alias("v")).collect()}
        for r in getattr(pixels, name)(slow, width=w, height=h).collect():
            for field, want in r.asDict(True).items():
                if field != "image":
                    assert got[r.image][field] == (pytest.approx(want, abs=1e-9, rel=1e-9) if isinstance(want, float) else want), (name, r.image, field)
    hist = {r.image: r for r in pictures.histogram_features(fast).collect()}
    assert all(hist[r.image] == pytest.approx(r) if False else hist[r.image].entropy == pytest.approx(r.entropy) and hist[r.image].n_peaks == r.n_peaks for r in pixels.histogram_features(slow).collect())
    plain = {r.image: r for r in pixels.fallback_editing(slow).collect()}
    assert all(r.v.n_peaks == plain[r.image].n_peaks and r.v.entropy == pytest.approx(plain[r.image].entropy) for r in fast.select("image", pictures.fallback_editing().alias("v")).collect())
    steps = {r.image: r.colour_consistency for r in pixels.colour_consistency(slow, width=w, height=h).collect()}
    assert all(r.v == pytest.approx(steps[r.image]) for r in fast.select("image", pictures.colour_consistency().alias("v")).collect())
    slow.unpersist()


def test_odd_pictures_have_no_measures(spark):
    rows = [(1, 64, 64, None), (2, 64, 64, b"short"), (3, 2, 2, bytes(4)), (4, None, None, bytes(4)), (5, 3, 3, bytes(9))]
    t = spark.createDataFrame(rows, "image int, width int, height int, gray binary").withColumn("m_", F.lit("extra"))
    got = {r.image: r for r in scans.border_scan(t).collect()}
    assert {k for k, r in got.items() if r.tier == "error"} == {1, 2, 3, 4} and got[5].tier == "pass"
    assert scans.border_scan(t.limit(0)).count() == 0


def test_files_to_categories(spark, tmp_path):
    """Pictures of three sizes as PNG files, decoded once, every test on them, to a category; a broken file is an error."""
    for w, h in SIZES:
        for k in KINDS:
            (tmp_path / f"{k}_{w}x{h}.png").write_bytes(images.png_bytes(made(w, h, k)))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    rows = images.pictures(images.decoded(spark, str(tmp_path)))
    long = scans.unified(rows, ["borders", "specifications", "text"])
    got = {(r.filename, r.test): r for r in long.collect()}
    assert len(got) == 3 * 13 and all(got[f"{k}_{w}x{h}.png", "text"].status == "pass" for w, h in SIZES for k in KINDS)
    assert got["broken.png", "borders"].status == "error"
    assert all(got[f"framed_{w}x{h}.png", "borders"].status == "fail" for w, h in SIZES)
    assert all(got[f"{k}_{w}x{h}.png", "borders"].status == "pass" for w, h in SIZES for k in ("noise", "flat"))
    assert all(got[f"noise_{w}x{h}.png", "specifications"].reason == "too small" for w, h in SIZES)
    filed = verdicts.memberships(long.where("test = 'borders'"), ["filename"]).collect()
    assert {r.filename for r in filed if r.category == "invalid"} >= {f"framed_{w}x{h}.png" for w, h in SIZES}
    assert {r.filename for r in filed if r.category == "valid"} >= {f"noise_{w}x{h}.png" for w, h in SIZES}


def test_border_confidence_by_hand(spark):
    """The scan's confidence from its own methods, by the rule in plain Python."""
    t = pictures.measured(table(spark, 64, 64), *scans.BORDER_PARTS)
    for r in scans.with_borders(t).collect():
        b, m = r.b, r.m
        scores = []
        one = t.where(F.col("image") == r.image)
        o, s = one.select(pictures.obvious().alias("o"), pictures.simple(F.lit(b.contrast)).alias("s")).first()
        for on, weight, score in ((o.detected, 1.0, o.confidence), (s.detected, 0.8, s.score), (m.frame, 0.7, m.frame_score), (b.texture, 0.6, min(1.0, m.adapted_texture_ratio / 3))):
            if on:
                scores.append(weight * score)
        x = max(scores, default=0.0)
        base = x
        if m.noise > 25:
            x *= max(0.7, 1 - (m.noise - 25) / 50)
        if b.uniform:
            x *= 1.1 if base > 0.58 else 0.8
        if b.artifacts:
            x *= 0.85
        if b.vignette > 0.5 and base < 0.58:
            x *= 0.9
        x = x * 0.8 if x < 0.2 else 0.8 + (x - 0.8) * 0.5 if x > 0.8 else x
        assert b.confidence == pytest.approx(min(1.0, max(0.0, x)))
        assert b.detected == (bool(scores) and b.confidence > 0.35)


def test_editing_scan_uses_its_own_features(spark):
    t = table(spark, 64, 64).withColumns({"brisque": F.lit(70.0), "niqe": F.lit(None).cast("double"), "clipiqa": F.when(F.col("image") == "flat", 1.5)})
    got = {r.image: r for r in scans.editing_scan(t).collect()}
    for k in KINDS:
        g = made(64, 64, k).astype(float)
        e, f, h = kernels.edge_features(g), kernels.frequency_features(g), np.bincount(made(64, 64, k).ravel(), minlength=256) / 4096
        entropy, ks = -sum(p * np.log2(p) for p in h if p), np.abs(np.cumsum(h) - np.arange(1, 257) / 256).max()
        want = spark.range(1).select(
            sc.histogram_score(F.lit(float((h[0] + h[255]) * 100)), F.lit(float(entropy)), F.lit(float(ks))), sc.edge_score(F.lit(e["laplacian_variance"]), F.lit(e["edge_density"]), F.lit(e["high_freq_energy"])), sc.frequency_score(F.lit(f["high_freq"]), F.lit(f["frequency_variance"]))
        ).first()
        assert (got[k].histogram, got[k].edges, got[k].frequencies) == pytest.approx(tuple(want), abs=1e-6)
        assert got[k].n_models == 1


def test_registry_selects_and_falls_back(spark):
    assert scans.selected() == list(scans.REGISTRY) and scans.selected(["text", "borders"]) == ["borders", "text"] and scans.selected(without=["text"])[-1] == "editing"
    with pytest.raises(ValueError, match="odd"):
        scans.selected(["odd"])
    states = scans.available(["width", "height", "gray", "brisque"])
    assert states == {"specifications": "fallback", "borders": "full", "watermarks": "fallback", "editing": "fallback", "text": "fallback"}


def test_scorer_is_loaded_by_tasks_and_survives_bad_rows(spark):
    def load():
        return lambda names, sizes: [n / len(s) for s, n in zip(names, sizes)]

    rows = spark.createDataFrame([("ab", 4), ("", 1), ("abcd", 4)], "name string, n int")
    assert [r.score for r in scans.with_scorer(rows, "score", load, "name", "n", spare=-1.0).collect()] == [2.0, -1.0, 1.0]


def test_models_stand_in_for_each_other_and_are_asked_again(spark):
    def load():
        left = [2]

        def first(names):
            if any(n == "b" for n in names):
                raise ValueError("odd colours")
            if left[0]:
                left[0] -= 1
                raise RuntimeError("CUDA out of memory")
            return [[0.0, 3.0]] * len(names)

        return [first, lambda names: [[3.0, 0.0] if n == "b" else None for n in names]]

    rows = spark.createDataFrame([("a",), ("b",)], "name string").coalesce(1)
    got = {r.name: r for r in scans.watermark_batch(rows, load, "name").collect()}
    assert got["b"].has_watermark is False and got["b"].watermark_status == "pass"
    one = scans.watermark_batch(rows.where("name = 'a'"), load, "name").first()
    assert one.has_watermark and one.watermark_percent == pytest.approx(100 / (1 + np.exp(-3.0))) and one.watermark_status == "manual"
    texts = scans.text_batch(rows.withColumnRenamed("name", "image"), lambda: lambda names: [[{"text": "Summer sale", "confidence": 0.9, "detection": 0.9, "recognition": 0.9, "w": 30, "h": 9}] if n == "a" else None for n in names], "image")
    assert {r.image: (r.n_texts, r.status) for r in texts.collect()} == {"a": (1, "fail"), "b": (0, "error")}
    assert scans.models_to_use(["brisque", "niqe"], excluded=["niqe"]) == ["brisque", "clipiqa"] and scans.models_to_use(["brisque"], ["clipiqa", "odd"]) == ["clipiqa"]


def test_canny_by_brute_force():
    """Edges of a small picture by the definition, pixel by pixel."""
    g = made(18, 15, "framed", 5).astype(float)
    p = np.pad(g, 1, mode="reflect")
    h, w = g.shape
    gx = [[sum(k * (p[y + i, x + 2] - p[y + i, x]) for i, k in enumerate((1, 2, 1))) for x in range(w)] for y in range(h)]
    gy = [[sum(k * (p[y + 2, x + j] - p[y, x + j]) for j, k in enumerate((1, 2, 1))) for x in range(w)] for y in range(h)]
    size = [[abs(gx[y][x]) + abs(gy[y][x]) for x in range(w)] for y in range(h)]

    def at(y, x):
        return size[y][x] if 0 <= y < h and 0 <= x < w else 0

    peaks = set()
    for y in range(h):
        for x in range(w):
            dy, dx = [(0, 1), (1, 1), (1, 0), (1, -1)][round(np.arctan2(gy[y][x], gx[y][x]) / (np.pi / 4)) % 4]
            if at(y, x) > at(y - dy, x - dx) and at(y, x) >= at(y + dy, x + dx):
                peaks.add((y, x))
    edge = {q for q in peaks if at(*q) > 150}
    while more := {(y, x) for y, x in peaks - edge if at(y, x) > 50 and any((y + i, x + j) in edge for i in (-1, 0, 1) for j in (-1, 0, 1))}:
        edge |= more
    assert {tuple(q) for q in np.argwhere(kernels.canny(g)).tolist()} == edge


def test_small_contours_may_be_left_out():
    for k, seed in ((k, s) for k in KINDS for s in range(3)):
        edges = contours.enhanced_edges(made(50, 44, k, seed).astype(float))
        every, some = contours.outer_contours(edges), contours.outer_contours(edges, 0.1 * edges.size)
        assert contours.frame_contour(every, *edges.shape) == contours.frame_contour(some, *edges.shape)
        assert max((contours.area_of(p)[0] for p, _ in every), default=0) == max((contours.area_of(p)[0] for p, _ in some), default=0)
        assert len(some) <= len(every) and all(f[p[:, 1], p[:, 0]].all() for p, f in every)


def test_contours_of_a_drawn_frame():
    mask = np.zeros((40, 60), bool)
    mask[5:35, 8:52] = True
    mask[10:30, 14:46] = False
    found = contours.outer_contours(mask)
    assert len(found) == 1 and found[0][1].sum() == 30 * 44
    assert contours.area_of(found[0][0])[0] == 29 * 43
    shape = contours.frame_contour(found, 40, 60)
    area, around = 29 * 43, 2 * (29 + 43)
    want = 0.25 * (1 - 4 * np.pi * area / around**2) + 0.25 + 0.20 * (1 - np.hypot(int(29.5) - 30, int(19.5) - 20) / np.hypot(30, 20)) + 0.15 * (1 - abs(np.log(43 / 29)) / 2 if True else 0) + 0.15
    assert shape["frame_score"] == pytest.approx(want * 1.1)
