"""Assets against large catalogues: the interval join against every specification tried on every asset."""

import random

from gridproof.operators import specs

COLUMNS = [f.strip().split()[0] for f in specs.SCHEMA.split(", ")]


def fits(a, s):
    w, h, fmt, mode, dx, dy, mb = a
    if fmt not in s["formats"] or None in (w, h):
        return False
    if s["width"] is not None and s["height"] is not None:
        if (w, h) != (s["width"], s["height"]):
            return False
    elif w < (s["min_width"] or 0) or h < (s["min_height"] or 0):
        return False
    if s["dpi_x"] is not None:
        if dx is None or dy is None or abs(dx - s["dpi_x"]) > 5 or abs(dy - s["dpi_y"]) > 5:
            return False
    elif s["dpi_lo"] is not None and (dx is None or dy is None or s["dpi_hi"] is None or not (s["dpi_lo"] <= dx <= s["dpi_hi"] and s["dpi_lo"] <= dy <= s["dpi_hi"])):
        return False
    if s["max_file_size_mb"] is not None and (mb is None or mb > s["max_file_size_mb"]):
        return False
    return {"CMYK": mode == "CMYK", "RGB": mode in ("RGB", "RGBA")}.get(s["color_mode"], True)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        exact, dpi = rng.random() < 0.3, rng.choice(["x", "range", "half", "none"])
        low = rng.choice([0.0, 1.0, 72.0, 150.0, 299.5])
        rows.append((k, "c", rng.choice(["print", "web"]) + str(k), rng.choice([640, 800, 2480]) if exact else None, rng.choice([480, 600]) if exact else None, rng.choice([None, 0, 300, 801]), rng.choice([None, 500]),
                     72.0 if dpi == "x" else None, 72.0 if dpi == "x" else None, low if dpi in ("range", "half") else None, low + rng.choice([0.0, 10.0, 1e6, -5.0]) if dpi == "range" else None, rng.choice([["JPEG"], ["PNG", "PNG", "TIFF"], []]), rng.choice([None, "CMYK", "RGB"]), rng.choice([None, None, 0.5, 2.0])))
    rows += rows[:3]  # repeated specifications
    assets = [(rng.choice([640, 800, 2480, 300, None]), rng.choice([480, 600, 5000]), rng.choice(["JPEG", "PNG", "TIFF", None]), rng.choice(["RGB", "CMYK", "L", None]), d := rng.choice([72.0, 66.9, 77.0, 150.0, 299.5, None, 1e12, 0.0]), rng.choice([d, 72.0]), rng.choice([0.5, 0.51, 3.0, None])) for _ in range(400)]
    return rows, assets + [assets[0]] * 200  # a third are alike


def test_interval_join_as_every_pair(spark):
    rows, assets = made(1)
    table = spark.createDataFrame([(i, *a, "x") for i, a in enumerate(assets)], "doc_id int, width int, height int, format string, mode string, dpi_x double, dpi_y double, file_size_mb double, spec string")
    listed = spark.createDataFrame(rows, specs.SCHEMA)
    named = [dict(zip(COLUMNS, r)) for r in rows]
    want = []
    for i, a in enumerate(assets):
        met = [((100 if "print" in s["spec"] else 0) + (10 if s["width"] is not None and s["height"] is not None else 0), -s["spec_ord"], f"c_{s['spec']}") for s in named if fits(a, s)]
        want.append((i, bool(met), max(met)[2] if met else None))
    got = specs.spec_match(table, listed)
    assert sorted(tuple(r) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    few = listed.where("spec_ord < 60")
    literal = sorted(tuple(r) for r in specs.spec_match(table, few.dropDuplicates(["spec_ord"])).collect())
    assert sorted(tuple(r) for r in specs.catalogue_match(table, few).collect()) == literal
    assert specs.catalogue_match(table.limit(0), listed).collect() == []
    assert {r.matched for r in specs.catalogue_match(table, listed.limit(0)).collect()} == {False}


def joined_rows(plan):
    """Rows that the joins of a plan that has run gave, at most."""
    name, inner = plan.nodeName(), []
    if name.startswith("AdaptiveSparkPlan"):
        inner = [plan.executedPlan()]
    elif name.endswith("QueryStage"):
        inner = [plan.plan()]
    children = plan.children()
    inner += [children.apply(i) for i in range(children.size())]
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name and plan.metrics().contains("numOutputRows") else 0
    return max([own, *map(joined_rows, inner)])


def test_alike_rows_do_not_meet_one_by_one(spark):
    """3,000 assets of other bytes and 3,000 specifications that take them: as many rows as assets, not nine million."""
    ask = "'c' AS category, CAST(NULL AS INT) AS width, CAST(NULL AS INT) AS height, 100 AS min_width, 100 AS min_height, CAST(NULL AS DOUBLE) AS dpi_x, CAST(NULL AS DOUBLE) AS dpi_y, 70D AS dpi_lo, 80D AS dpi_hi, array('PNG') AS formats, CAST(NULL AS STRING) AS color_mode"
    listed = spark.range(3000).selectExpr("CAST(id AS INT) AS spec_ord", "concat('s', id) AS spec", *ask.split(", "), "IF(id = 2999, NULL, (id * 7 % 2999) / 100D) AS max_file_size_mb").select(*COLUMNS)
    table = spark.range(3000).selectExpr("id AS doc_id", "640 AS width", "480 AS height", "'PNG' AS format", "'RGB' AS mode", "72D AS dpi_x", "72D AS dpi_y", "id / 90D AS file_size_mb")
    found = specs.spec_match(table, listed)
    got = {r.doc_id: r.spec for r in found.collect()}
    limits = [(i * 7 % 2999) / 100 for i in range(2999)] + [float("inf")]
    assert got == {i: f"c_s{next(k for k, most in enumerate(limits) if i / 90 <= most)}" for i in range(3000)}
    assert joined_rows(found._jdf.queryExecution().executedPlan()) <= 10_000
