"""The text queries run on whole texts and use only what the filter keeps: against plain Python."""

import os
import re
import statistics

import duckdb
import pytest

from gridproof.plans import catalog

SF = "/root/testdata/sf0.001"
NOISE = ["aaa", "--", "aaaaaaa", "ab", "Sale", "...!", "aaa\n", "\t-- "]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def found():
    """(image, nth, text, confidence, detection, area) of every finding."""
    rows = []
    for c, t, x in duckdb.sql(f"SELECT conv_id, turn, text FROM '{SF}/conversations.parquet'").fetchall():
        for nth, text in ((t, x), (t + 1000, NOISE[t % len(NOISE)])):
            rows.append((c, nth, text, (c * 31 + t * 17) % 100 / 100, (c * 7 + t * 3) % 100 / 100, (c * 13 + t * 7) % 40 * ((c * 5 + t * 11) % 30)))
    return rows


def noise(text):
    t = text.strip().lower()
    return len(t) <= 3 and len(set(t)) == 1 or len(t) >= 4 and len(set(t)) / len(t) < 0.3 or bool(re.match(r"^[^\w\s]{2,}$", t))


def kept(row):
    _, _, text, confidence, _, area = row
    return confidence >= 0.6 and 1 <= len(text) <= 500 and area >= 50 and any(c.isprintable() and not c.isspace() for c in text) and not noise(text)


def test_texts_are_whole_and_filtered(spark, found):
    got = {(r.image, r.nth): (r.text, r.noise, r.kept) for r in catalog.QUERIES["noise_filter"](spark, SF).collect()}
    assert got == {(r[0], r[1]): (r[2], noise(r[2]), kept(r)) for r in found}
    assert max(len(t) for t, _, _ in got.values()) > 500 and any(k for _, _, k in got.values())


def test_confidence_is_over_kept_texts(spark, found):
    got = {r.image: r for r in catalog.QUERIES["ocr_confidence"](spark, SF).collect()}
    assert set(got) == {r[0] for r in found}
    for c, r in got.items():
        own = [x for x in found if x[0] == c and kept(x)]
        weight = sum(len(x[2]) * x[3] for x in own)
        assert (r.n_texts, r.text_length) == (len(own), sum(len(x[2]) for x in own))
        assert r.overall_confidence == pytest.approx(100 * sum(len(x[2]) * x[3] ** 2 for x in own) / weight if weight else 0, abs=1e-5)
        assert r.detection_confidence == pytest.approx(100 * statistics.fmean(x[4] for x in own) if own else 0, abs=1e-5)
