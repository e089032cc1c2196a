"""Stages of the pipeline keep every column of their input as it was, whatever it is called."""

import random

import corpus_pipeline

NAMES = ["_own_nth", "_found", "_low", "_model", "_row", "row", "key", "found", "model", "own_id", "keep_id", "fp"]
PROSE = "the quick brown fox jumps over the lazy dog while seven grey cats sleep near the warm old stove and dream of fish "


def table(spark, rows):
    kinds = ", ".join(f"{n} {'int' if i % 2 else 'string'}" for i, n in enumerate(NAMES))
    extra = [(i if k % 2 else f"{n}{i}") for i in range(1) for k, n in enumerate(NAMES)]
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, {kinds}"), extra


def test_clashing_names_come_back_unchanged(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(PROSE.split(), k=80)), "en") for k in range(40)] + [(50, None, "en"), (51, "", None), (53, "zzz qqq", "en")]
    rows.append((54, *rows[3][1:]))
    docs, extra = table(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns
        found = kept.collect()
        assert found and all(list(r)[3:] == extra for r in found)
        assert stage(spark, docs.limit(0), "").collect() == []


def test_repeats_of_one_row_leave_one(spark):
    """A third of all rows are equal, another third have no doc_id and one text: each task gives one of them."""
    other = [(k, " ".join(f"{PROSE.split()[(k * 7 + j) % 20]}{k}" for j in range(60)), "en") for k in range(1200)]
    rows = other + [(5000, PROSE, "en")] * 1200 + [(None, PROSE + "but no fish ever came", "de")] * 1200 + [(None, None, None)] * 3
    docs, _ = table(spark, rows)
    left = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(4), "").collect()
    ids = [r.doc_id for r in left]
    assert ids.count(5000) == 1 and sum(r.text == PROSE + "but no fish ever came" for r in left) <= 1 and sum(r.text is None for r in left) == 1
    assert len(set(ids) & set(range(1200))) >= 1190
