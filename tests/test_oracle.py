"""Every query with SQL gives the rows that DuckDB gives for that SQL over the same tables."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from gridproof.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.6g}")  # six significant digits: sums may differ in their last bits
    return v


def rows(frame):
    names = sorted(frame[0])
    return Counter(tuple(plain(v) for v in row) for row in zip(*(frame[1][n] for n in names)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas().astype(object)
    want = duck.sql(catalog.ORACLE_SQL[name]).df().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = (rows((list(x.columns), {c: [None if pd.api.types.is_scalar(v) and pd.isna(v) else v for v in x[c]] for c in x.columns})) for x in (got, want))
    assert not (a - b) and not (b - a), (list((a - b).items())[:3], list((b - a).items())[:3])


#: Held against plain Python instead: contours and hysteresis have no SQL, and scans over pictures use them.
WITHOUT_SQL = {"canny_features", "frame_contours", "border_scan", "editing_scan", "unified_scan", "picture_routine"}


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == WITHOUT_SQL
