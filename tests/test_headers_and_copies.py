"""Headers by a few bytes against whole files; copies into a folder in use, retried and undone."""

import os
import shutil
import struct

import numpy as np
import pytest

from gridproof.sources import copies, headers, images


def jpeg(width, height, before=0):
    exif = b"".join(b"\xff\xe1" + struct.pack(">H", 60002) + b"x" * 60000 for _ in range(before))
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\1" + struct.pack(">HH", 300, 300) + b"\0\0" + exif + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\0" * 50_000


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "pictures"
    os.makedirs(root / "deep" / "er")
    rng = np.random.default_rng(0)
    for i in range(7):
        (root / f"p{i}.PNG").write_bytes(images.png_bytes(rng.integers(0, 256, (90 + i, 200))))
    (root / "deep" / "a.jpg").write_bytes(jpeg(640, 480))
    (root / "deep" / "er" / "exif.JPEG").write_bytes(jpeg(800, 600, before=3))
    (root / "deep" / "broken.jpg").write_bytes(b"\xff\xd8 not a picture" * 9)
    (root / "empty.png").write_bytes(b"")
    (root / "text.txt").write_bytes(b"text")
    (root / "none").write_bytes(b"png")
    (root / "tagged.tif").write_bytes(b"II*\0" + struct.pack("<I", 6000) + b"\0" * 5992 + struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 77) + struct.pack("<HHII", 257, 4, 1, 55))
    return root


def test_same_rows_as_from_whole_files(spark, folder):
    whole = images.image_properties(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)))
    want = {r.path: tuple(r) for r in whole.collect()}
    got = headers.image_headers(spark, str(folder), filesPerPartition="3").drop("filename", "extension", "length")
    found = {r.path: tuple(r)[:-1] for r in got.collect()}
    assert found.pop(f"file:{folder}/empty.png")[1:] == (None,) * 6 + (0.0,)  # Spark's own file source has no row for it
    assert found == {p: w for p, w in want.items() if p.rpartition(".")[2].lower() in images.EXTENSIONS["recursive"]} and len(found) == 11
    read = {os.path.basename(r.path): r.bytes_read for r in got.collect()}
    assert read["p0.PNG"] == 4096 and read["a.jpg"] == 4096 and 180_000 < read["exif.JPEG"] <= 262_144 and read["empty.png"] == 0
    assert got.rdd.getNumPartitions() == 4


def test_filters_reach_the_source(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = headers.image_headers(spark, f"file:{folder}")
        assert sorted(r.filename for r in rows.where("extension = 'jpg' AND length > 1000").collect()) == ["a.jpg"]
        assert rows.where("extension IN ('png', 'jpeg') AND length >= 1 AND width > 300").count() == 1
        reader = headers.FilteringReader({"path": str(folder)})
        kept = list(reader.pushFilters([headers.EqualTo(("extension",), "jpg"), headers.GreaterThan(("length",), 1000), headers.EqualTo(("width",), 640)]))
        assert len(kept) == 1 and [os.path.basename(p) for part in reader.partitions() for p, _ in part.files] == ["a.jpg"]
        assert headers.image_headers(spark, str(folder), "master").count() == 9  # not in subfolders
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def by_rule(new, there):
    """Names one after another: the first that neither a file nor another name of the plan has."""
    literal = {(f, n) for f, n, _ in new}
    used, out = set(there), {}
    for f, n, p in sorted(new, key=lambda r: (r[0], r[1], r[2])):
        stem, dot, ext = n.rpartition(".")
        stem, ext = (stem, dot + ext) if dot else (n, "")
        k = 0
        while (f, name := n if k == 0 else f"{stem}_{k}{ext}") in used or k and (f, name) in literal:
            k += 1
        used.add((f, name))
        out[p] = f"{f}/{name}"
    return out


def test_names_beside_what_is_there(spark):
    there = [("valid", "a.jpg"), ("valid", "a_2.jpg"), ("valid", "b_1.jpg"), ("invalid", "a_1.jpg"), ("valid", "c_01.jpg"), ("valid", "x_0.jpg")]
    new = [("valid", "a.jpg", f"/in/{i:03}") for i in range(40)] + [("valid", "a_5.jpg", "/in/x1"), ("valid", "a_5.jpg", "/in/x2"), ("valid", "b.jpg", "/in/y1"), ("valid", "b.jpg", "/in/y2"), ("invalid", "a.jpg", "/in/z1"), ("invalid", "a.jpg", "/in/z2"), ("valid", "noext", "/in/w1"), ("valid", "noext", "/in/w2"), ("valid", "c.jpg", "/in/v1"), ("valid", "c.jpg", "/in/v2")]
    plan = spark.createDataFrame([*new, (None, "a.jpg", "/in/none")], "folder string, filename string, path string").repartition(3)
    got = {r.path: r.target for r in copies.names_beside(plan, spark.createDataFrame(there, "folder string, name string")).collect()}
    assert got.pop("/in/none") is None and got == by_rule(new, there)


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def test_two_runs_into_one_folder_and_a_failed_one(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    os.makedirs(source)
    rows = []
    for i in range(6):
        os.makedirs(source / str(i))
        (source / str(i) / "a.jpg").write_bytes(f"file {i}".encode())
        rows.append(("valid" if i % 2 else "invalid", "a.jpg", str(source / str(i) / "a.jpg")))
    plan = spark.createDataFrame(rows, "folder string, filename string, path string").repartition(2)
    first = copies.copy_committed(plan, str(root)).collect()
    assert {r.error for r in first} == {None} and len(tree(root)) == 6
    again = copies.copy_committed(plan, f"file:{root}").collect()  # the same names once more
    assert len(tree(root)) == 12 and not {r.target for r in first} & {r.target for r in again}
    assert tree(root)["valid/a_5.jpg"] == b"file 5" and not any(n.startswith("_copying") for n in os.listdir(root))
    before = tree(root)
    bad = plan.union(spark.createDataFrame([("valid", "gone.jpg", str(source / "gone.jpg"))], plan.schema))
    with pytest.raises(OSError, match="gone.jpg"):
        copies.copy_committed(bad, str(root))
    assert tree(root) == before and not any(n.startswith("_copying") for n in os.listdir(root))
    told = copies.copy_committed(bad, str(root), all_or_none=False).collect()
    assert [r.error for r in told if r.error] == ["FileNotFoundError: No such file or directory"] and len(tree(root)) == 18
    shutil.rmtree(root)
    assert copies.copy_committed(plan.limit(0), str(root)).collect() == []
