"""Thresholds at their boundaries, odd values, image files and streams."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridproof.functions import scores, tiers
from gridproof.operators import contours, kernels, ocr, pictures, pixels, specs
from gridproof.sources import configs, copies, images
from gridproof.streaming import scans


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, column, rows, schema):
    return [r[0] for r in values(spark, rows, schema, column)]


def test_text_tier(spark):
    rows = [(80.0, 5), (80.1, 0), (60.0, 2), (60.1, 0), (0.0, 6), (0.0, 3)]
    assert one(spark, tiers.text_tier(F.col("c"), F.col("n")), rows, "c double, n int") == ["manual", "fail", "pass", "manual", "fail", "manual"]


def test_watermark_tier(spark):
    rows = [(True, 96.0), (True, 96.1), (True, 91.0), (True, 91.1), (False, 99.0), (None, 99.0)]
    assert one(spark, tiers.watermark_tier(F.col("h"), F.col("p")), rows, "h boolean, p double") == ["manual", "fail", "pass", "manual", "pass", "error"]


def test_editing_and_border_tiers(spark):
    s = F.col("s")
    assert one(spark, tiers.editing_tier(s), [(30.0,), (30.1,), (25.0,), (24.9,), (math.nan,), (None,)], "s double") == ["manual", "fail", "manual", "pass", "error", "error"]
    assert one(spark, tiers.editing_pipeline_tier(s), [(25.0,), (20.0,), (19.9,)], "s double") == ["fail", "manual", "pass"]
    assert one(spark, tiers.border_tier(s), [(0.58,), (0.5799,), (0.35,), (0.3499,)], "s double") == ["fail", "manual", "manual", "pass"]


def test_scores(spark):
    got = one(spark, scores.brisque_norm(F.col("s")), [(31.4,), (58.2,), (80.5,), (200.0,), (math.inf,)], "s double")
    assert got[:4] == pytest.approx([0, 50, 85, 95]) and got[4] is None
    assert one(spark, scores.clipiqa_norm(F.col("s")), [(1.2,), (0.05,), (0.8,)], "s double") == [None, None, 0.0]
    assert one(spark, scores.calibrated(F.col("s")), [(0.1,), (0.5,), (1.0,)], "s double") == pytest.approx([0.08, 0.5, 0.9])


def test_noise_text(spark):
    assert one(spark, ocr.is_noise(F.col("t")), [("aaa",), ("--",), ("aaaaaaa",), ("ab",), ("üü",), ("Sale",), ("",)], "t string") == [True, True, True, False, True, False, False]


def test_specifications(spark):
    schema = "doc_id int, width int, height int, format string, mode string, dpi_x double, dpi_y double, file_size_mb double"
    rows = [
        (1, 1920, 705, "JPEG", "RGB", 77.0, 72.0, 9.0), (2, 1920, 705, "JPEG", "RGB", 77.01, 72.0, 9.0), (3, 1920, 705, "Jpeg", "RGB", 72.0, 72.0, 9.0), (4, 2480, 3508, "PNG", "RGBA", 150.0, 200.0, 1.0),
        (5, 2480, 3508, "PNG", "RGB", 149.9, 200.0, 1.0), (6, 2480, 3508, "TIFF", "RGB", 300.0, 300.0, 1.0), (7, 2480, 3508, "TIFF", "CMYK", 305.0, 295.0, 1.0), (8, None, None, None, None, None, None, None),
    ]
    got = {r.doc_id: r.spec for r in specs.spec_match(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "website_slider", 2: None, 3: None, 4: "publication_digital_a4", 5: None, 6: None, 7: "publication_print_a4", 8: None}
    assert specs.spec_faults(specs.catalogue(spark)).count() == 0


def test_polygon_and_zip(spark):
    rows = [([(1, 2), (5, 2), (5, 9), (1, 9)], ["a", "b", "c"], [0.5, 0.6])]
    box, turn, z = values(spark, rows, "p array<struct<x int, y int>>, t array<string>, s array<double>", ocr.bounding_box(F.col("p")), ocr.angle(F.col("p")), ocr.zipped(F.col("t"), F.col("s"), F.col("s")))[0]
    assert tuple(box) == (1, 2, 5, 8) and turn == 0.0 and len(z) == 2


def test_kernels():
    flat = np.full((16, 16), 255.0)
    assert kernels.edge_features(flat) == {"laplacian_variance": 0.0, "edge_density": 0.0, "edge_contrast": 0.0, "halo_variance": 0.0, "high_freq_energy": 0.0}
    step = np.zeros((32, 32))
    step[:, 16:] = 200
    edges = kernels.canny(step)
    assert edges[:, 15:17].any(1).all() and not edges[:, :14].any()
    wave = np.cos(np.arange(64) * np.pi)[None, :].repeat(64, 0)
    assert kernels.frequency_features(wave)["high_freq"] == pytest.approx(1.0)
    dot = np.full((9, 9), 10.0)
    dot[4, 4] = 5
    assert kernels.noise_deviation(dot) == pytest.approx(np.std([251] + [0] * 80))


def picture(spark, arrays):
    rows = [(k, x, y, int(a[y, x])) for k, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image string, x int, y int, gray int")


def test_gradients_are_sobel(spark):
    a = np.random.default_rng(1).integers(0, 256, (6, 9))
    got = {(r.y, r.x): r.magnitude for r in pixels.gradients(picture(spark, {"a": a})).collect()}
    want = np.hypot(*kernels.sobel(a))
    assert all(got[y, x] == pytest.approx(want[y, x]) for y in range(6) for x in range(9))


def test_borders_of_made_pictures(spark):
    rng = np.random.default_rng(2)
    noise = rng.integers(60, 140, (64, 64))
    framed, dark = np.full((64, 64), 250), np.full((64, 64), 250)
    framed[5:59, 5:59] = noise[5:59, 5:59]
    y, x = np.mgrid[:64, :64]
    dark = np.clip(230 - ((x - 32) ** 2 + (y - 32) ** 2) // 10, 0, 255)
    table = picture(spark, {"framed": framed, "noise": noise, "dark": dark, "flat": np.full((64, 64), 90)})

    def of(f, field):
        return {r.image: r[field] for r in f(table).collect()}

    assert of(pixels.obvious_border, "detected") == {"framed": True, "noise": False, "dark": False, "flat": False}  # the dark sides are not even
    assert of(pixels.obvious_border, "border_width")["framed"] in (3, 4, 5, 6) and of(pixels.obvious_border, "border_width")["flat"] == 0
    simple = of(pixels.simple_border, "detected")
    assert simple["framed"] and not simple["noise"] and not simple["flat"]
    assert of(pixels.vignette, "vignetted") == {"framed": False, "noise": False, "dark": True, "flat": False}
    assert of(pixels.border_symmetry, "symmetric")["framed"] and of(pixels.gradient_ratio, "framed")["framed"]
    assert of(pixels.border_region, "border_width")["framed"] == 6 and of(pixels.border_region, "regions")["flat"] == []
    assert of(pixels.side_measures, "least_uniformity")["framed"] == 1.0
    assert of(pixels.uniform_background, "uniform") == {"framed": False, "noise": False, "dark": False, "flat": True}
    assert pixels.simple_border(table.limit(0)).count() == 0


def test_textured_frame_is_by_region():
    flat = np.full((40, 40), 100.0)
    flat[:6] = np.random.default_rng(3).integers(0, 256, (6, 40))
    assert kernels.texture_frame(flat)["textured"] and not kernels.texture_frame(np.full((40, 40), 7.0))["textured"]


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    gray = rng.integers(0, 256, (64, 64))
    (tmp_path / "in").mkdir()
    (tmp_path / "A.PNG").write_bytes(images.png_bytes(gray))
    (tmp_path / "in" / "b.png").write_bytes(images.png_bytes(np.full((64, 64), 255)))
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    (tmp_path / "c.gif").write_bytes(b"")
    folder = str(tmp_path)
    assert [r.filename for r in images.image_files(spark, folder).collect()] == ["A.PNG", "bad.jpg", "b.png"]
    assert {r.filename for r in images.image_files(spark, folder, "border").collect()} == {"A.PNG", "bad.jpg"}
    assert [r.filename for r in images.slice_scan(images.image_files(spark, folder), 1, 1).collect()] == ["bad.jpg"]
    props = {r.path.rsplit("/", 1)[1]: r for r in images.image_properties(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)).collect()}
    assert (props["A.PNG"].width, props["A.PNG"].format, props["A.PNG"].mode) == (64, "PNG", "L") and props["bad.jpg"].format is None
    table = images.pixel_table(images.decoded(spark, folder).where("path LIKE '%.png' OR path LIKE '%.PNG'"))
    hist = {r.image.rsplit("/", 1)[1]: r for r in pixels.histogram_features(table).collect()}
    p = np.bincount(gray.ravel(), minlength=256) / 4096
    assert hist["A.PNG"].entropy == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum()) and hist["A.PNG"].smoothness == pytest.approx(1 / (1 + np.diff(p).var()))
    assert hist["b.png"].entropy == 0 and hist["b.png"].white_clipping == 100
    rows = [(1, 64, 64, bytes(gray.astype(np.uint8).ravel())), (2, 0, 0, None)]
    got = [r.m for r in pictures.measured(spark.createDataFrame(rows, "image int, width int, height int, gray binary"), "kernels").orderBy("image").collect()]
    assert got[0].low_freq + got[0].mid_freq + got[0].high_freq == pytest.approx(1.0) and got[1] is None


def test_stream_validates_once(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:10"), ("b", "2024-01-01 00:00:20")]
    spark.createDataFrame(rows, "path string, t string").selectExpr("path", "CAST(t AS timestamp) AS ts").write.parquet(str(tmp_path / "in"))
    stream = scans.validated_once(scans.asset_stream(spark, str(tmp_path / "in"), "path string, ts timestamp"))
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.path for r in spark.sql("SELECT path FROM once").collect()) == ["a", "b"]


def test_settings(spark, tmp_path):
    assert configs.BorderSettings().faults() == configs.SystemSettings().faults() == configs.DetectorSettings().faults() == []
    (tmp_path / "a.json").write_text('{"COLOR_DIFF_THRESHOLD": 20, "unknown": 1}')
    (tmp_path / "b.json").write_text('{"confidence_threshold_low": 0.9}')
    (tmp_path / "c.json").write_text("not json")
    (tmp_path / "d.json").write_text('{"processing_mode": "other", "cache_size": 9}')
    (tmp_path / "e.json").write_text('{"text_count_thresholds": 5}')
    read = lambda name, kind=configs.BorderSettings: configs.read_settings(spark, str(tmp_path / name), kind)
    assert read("a.json").color_diff_threshold == 20
    assert read("b.json") == read("c.json") == read("missing.json") == configs.BorderSettings()
    assert read("d.json", configs.SystemSettings) == read("e.json", configs.SystemSettings) == configs.SystemSettings()
    assert configs.settings_of(configs.BorderSettings, {"apply_gaussian_blur": True, "use_bilateral_filter": True}) == configs.BorderSettings()
    configs.write_settings(spark, configs.DetectorSettings(max_retry_attempts=7), str(tmp_path / "w"))
    assert read("w", configs.DetectorSettings).max_retry_attempts == 7


def test_copies(spark, tmp_path):
    for name in ("a/x.png", "b/x.png", "c/y.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    rows = [(f"{tmp_path}/a/x.png", "x.png", "fail"), (f"file://{tmp_path}/b/x.png", "x.png", "fail"), (f"{tmp_path}/c/y.png", "y.png", "odd"), (f"{tmp_path}/no.png", "no.png", "pass"), (f"{tmp_path}/a/x.png", "x.png", None)]
    table = spark.createDataFrame(rows, "path string, filename string, status string")
    plan = copies.copy_plan(table, "tier")
    assert sorted(str(r.target) for r in plan.collect()) == ["None", "invalid/x.png", "invalid/x_1.png", "invalid/y.png", "valid/no.png"]
    done = {r.target: r.error for r in copies.copy_files(plan, str(tmp_path / "out")).collect()}
    assert done.pop("valid/no.png").startswith("FileNotFoundError") and set(done.values()) == {None}
    assert sorted(p.name for p in (tmp_path / "out" / "invalid").iterdir()) == ["x.png", "x_1.png", "y.png"]
    last = copies.copy_plan(table, "tier", clash="last")
    assert last.count() == 5 and last.where("target = 'invalid/x.png'").count() == 1
    for status in ("pass", "fail"):
        copies.write_by_status(table.where(F.col("status") == status), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 3


def test_outer_contours_and_shapes():
    mask = np.zeros((40, 50), bool)
    mask[5:35, 5:45] = True
    mask[8:32, 8:42] = False  # a ring
    mask[15:20, 15:20] = True  # enclosed by it
    mask[38, 2] = True
    found = contours.outer_contours(mask)
    assert len(found) == 2
    ring, filled = max(found, key=lambda c: len(c[0]))
    assert contours.area_of(ring) == (29 * 39, (24.5, 19.5)) and contours.length_of(ring) == 2 * (29 + 39) and filled.sum() == 30 * 40
    assert {tuple(p) for p in contours.simplified(ring, 2.0)} == {(5, 5), (44, 5), (44, 34), (5, 34)}
    assert contours.least_rectangle(ring)[:3] == (39, 29, 0)
    turned = np.array([(10, 0), (20, 10), (10, 20), (0, 10)])
    assert contours.least_rectangle(turned)[:3] == pytest.approx((200**0.5, 200**0.5, 45))
    got = contours.frame_contour(found, 40, 50)
    assert got["frame"] and got["frame_score"] > 0.7
    assert not contours.frame_contour(found, 40, 50, perimeter=np.zeros((40, 50), bool))["frame"] and contours.frame_contour([], 40, 50) == {"frame": False, "frame_score": 0.0}
    assert contours.quadrilateral(ring, 40, 50)["quad"]


def test_frame_features(spark):
    g = np.full((48, 48), 40, np.uint8)
    g[2:46, 2:46] = 220
    flat = contours.bilateral(np.full((20, 20), 9.0))
    assert (flat == 9).all() and contours.local_equalised(flat).std() == 0
    rows = [(1, 48, 48, bytes(g.ravel())), (2, 48, 48, None), (3, 4, 4, bytes(16)), (4, 32, 32, bytes(1024))]
    got = {r.image: r.m for r in pictures.measured(spark.createDataFrame(rows, "image int, width int, height int, gray binary"), "frames").collect()}
    assert len(got) == 4 and got[2] is None and got[3].boxes == []
    assert len(got[1].boxes) == 1 and got[1].boxes[0].w >= 43
    assert got[4].boxes == []


def test_colour_spaces(spark):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    rows = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255), (0, 0, 0)]
    got = values(spark, rows, "r int, g int, b int", *pixels.hsv(r, g, b).values(), *pixels.lab(r, g, b).values())
    assert got[0] == (0, 255, 255, 136, 208, 195) and got[1][:3] == (60, 255, 255) and got[2][:3] == (120, 255, 255)
    assert got[3] == (0, 0, 255, 255, 128, 128) and got[4] == (0, 0, 0, 0, 128, 128)


def test_other_headers():
    entries = [(256, 4, 1, 640), (257, 3, 1, 480), (262, 3, 1, 5), (277, 3, 1, 4), (282, 5, 1, 200), (283, 5, 1, 200), (296, 3, 1, 3)]
    for order, mark in (("<", b"II*\0"), (">", b"MM\0*")):
        body = struct.pack(f"{order}H", len(entries))
        for tag, kind, n, v in entries:
            body += struct.pack(f"{order}HHI", tag, kind, n) + (struct.pack(f"{order}HH", v, 0) if kind == 3 else struct.pack(f"{order}I", v))
        data = (mark + struct.pack(f"{order}I", 8) + body).ljust(200, b"\0") + struct.pack(f"{order}II", 1181, 10)
        assert images.header(data) == ("TIFF", 640, 480, "CMYK", pytest.approx(299.974), pytest.approx(299.974))
        assert images.header(data[:30]) == (None,) * 6
    wide = b"RIFF\0\0\0\0WEBPVP8X" + bytes(4) + b"\x10" + bytes(3) + (1919).to_bytes(3, "little") + (704).to_bytes(3, "little")
    assert images.header(wide)[:4] == ("WEBP", 1920, 705, "RGBA") and images.header(b"RIFF") == (None,) * 6


def test_flat_top_is_one_peak(spark):
    gray = np.repeat([10, 11, 50, 50, 52], [8, 8, 4, 4, 1]).reshape(5, 5)  # bins 10 and 11 alike, 50, and a low one
    got = pixels.histogram_features(picture(spark, {"a": gray})).first()
    assert got.n_peaks == 3
