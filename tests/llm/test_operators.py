"""The training-data operators against brute force, round trips and held-out accuracy, and over odd rows."""

import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from gridproof.llm import chat_windows, language_id, lattice, licenses, packing, quality_rules, queries, rule_ensemble, sentence_pieces, simhash, token_codes
from gridproof.llm.common import components, union_labels
from gridproof.llm.tokens import ChunkTable

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
LONG = "word " * 30_000
ODD = [
    (1, None, None, None, None, None, None), (2, "", "en", "s", 0, 1.0, "x"), (3, "...", "en", None, 3, None, None), (4, "A", None, "s", 1, 0.0, ""),
    (5, LONG, "en", "s", len(LONG), 1.0, "x"), (6, "the cat sat on the mat " * 20, "en", "s", 1, 1.0, "x"), (6, "the cat sat on the mat " * 20, "en", "s", 1, 1.0, "x"),
    (7, "the cat sat on the mat " * 20, "en", "s", 1, 1.0, "x"), (None, "le chat est sur la table", "fr", "s", 1, 1.0, "x"), (None, None, None, None, None, None, None), (8, "é 中文 \x00 \t ok", "fr", "s", 1, 1.0, "x"),
]


def spark_of(frame):
    return frame.sparkSession


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


ROWWISE = {
    "quality": lambda d: quality_rules.quality_rules(d),
    "simhash": lambda d: simhash.simhash_groups(d),
    "language": lambda d: language_id.language_id(d),
    "licenses": lambda d: licenses.license_scan(d),
    "pieces": lambda d: sentence_pieces.piece_digests(d, public_tokenizers.path("piece_bpe_32k.model")),
    "classifier": lambda d: rule_ensemble.quality_scores(d, d.sparkSession.createDataFrame([(4, 0), (5, 1), (6, 1), (None, 1)], "doc_id long, quality int")),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_odd_rows_are_answered_each(odd, empty, name):
    assert ROWWISE[name](odd).count() == len(ODD)
    assert ROWWISE[name](empty).count() == 0


def base_by_rule(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(threes) if threes.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality_base_counts(docs):
    texts = [r.text for r in docs.limit(60).collect()] + [None, "", " \n ", "a b c a b c\na b\na b\n", "a a a a", "é# \x0b*", "x\x1cy z"]
    for t in texts:
        assert quality_rules.base_counts(t) == base_by_rule(t)


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 6, 5000)
    grams = codes[3:] | codes[2:-1] << 5 | codes[1:-2] << 10 | codes[:-3] << 15
    model = quality_rules.KneserNey(*np.unique(grams, return_counts=True))
    for context in (grams[0] >> 5, 31 << 10 | 7):  # one that was seen, one that was not
        assert np.exp(model.log_lower(4, (context << 5) | np.arange(32))).sum() == pytest.approx(1.0, abs=1e-4)


def test_quality_keeps_good_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality_rules.quality_rules(docs).where("NOT base_failed").join(labels.where("quality = 1"), "doc_id")
    assert good.where("kept").count() >= 0.98 * good.count()


def fingerprint_by_rule(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_against_all_pairs(docs):
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    for r in docs.limit(40).collect():
        assert int(got[r.doc_id].fingerprint, 16) == fingerprint_by_rule(r.text)
    ids = sorted(got)
    fp = np.array([int(got[i].fingerprint, 16) for i in ids], np.uint64)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert [ids[k] for k in union_labels(len(ids), i, j)] == [got[i].component_id for i in ids]


def test_bit_sliced_links_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = np.unique(np.array([base[k % 6] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for k in range(400)], np.uint64))
    a, b, _ = simhash.sliced_links(fp, np.zeros(len(fp), int), np.full(len(fp), len(fp)), 4)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
    assert set(zip(a.tolist(), b.tolist())) == set(zip(i.tolist(), j.tolist()))
    monkeypatch.setattr(simhash, "TILE", 16)
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), 4, 6).toPandas()
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    got = union_labels(len(fp), found.a.map(at).to_numpy(), found.b.map(at).to_numpy())
    assert (got == union_labels(len(fp), i, j)).all()


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long"))
    roots = {r.node: r.root for r in components(edges).collect()}
    assert {roots[k] for k in range(61)} == {0} and roots[101] == 100


def test_language_held_out_accuracy(docs):
    got = language_id.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()


def test_background_takes_what_no_language_explains(spark):
    import random

    rng = random.Random(3)
    tongues = {c: ["".join(rng.choice(s) + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)] for c, s in (("aa", "bcdfg"), ("bb", "hjklm"), ("cc", "npqrst"), ("xx", "vwxyz"))}

    def prose(tongue, n):
        return " ".join(rng.choice(tongues[tongue]) for _ in range(n))

    rows = [(k, prose(t, 80), t) for k in range(120) for t in [("aa", "bb", "cc")[k % 3]]]
    rows += [(1000, prose("xx", 90), None), (1001, " ".join(prose(t, 40) for t in ("aa", "bb", "cc")), None), (1002, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(600)), None), (1003, "слово за слово " * 20, None)]
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].known < 0.5 for k in (1000, 1002, 1003))
    assert got[1001].known > 0.9 and got[1001].n_langs == 3 and all(abs(m.share - 1 / 3) < 0.1 for m in got[1001].mixture)
    assert all(got[k].lang_pred == lang and got[k].known > 0.9 for k, _, lang in rows[:120])


def test_mixture_against_plain_em(docs):
    """Counts, probabilities and EM to convergence over whole texts by dictionaries; the set by trying every subset."""
    from itertools import combinations

    from gridproof.llm.language_id import SIZE, trigrams

    rows = docs.select("doc_id", "text", "lang").limit(150).collect()
    counts, letters = {}, {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            code, _, c = trigrams([r.text])
            for g, x in zip(code.tolist(), c.tolist()):
                if g:
                    counts.setdefault(r.lang, {})[g] = counts.setdefault(r.lang, {}).get(g, 0) + 1
                    letters[x] = letters.get(x, 0) + 1
    langs, total = sorted(counts), sum(sum(c.values()) for c in counts.values())
    both = {g: sum(c.get(g, 0) for c in counts.values()) for c in counts.values() for g in c}

    def chance(lang, g):
        return (counts[lang].get(g, 0) + 1000 * (both.get(g, 0) + 0.05) / (total + 0.05 * SIZE)) / (sum(counts[lang].values()) + 1000)

    def letter(x):
        return (letters.get(x, 0) + 0.5) / (sum(letters.values()) + 0.5 * 0x110000)

    got = {r.doc_id: r for r in language_id.language_id(spark_of(docs).createDataFrame(rows)).collect()}
    for r in rows[:25]:
        code, _, c = trigrams([r.text])
        c = [0, 0, *c.tolist()]
        grams = {}
        for i, g in enumerate(code.tolist()):
            if g:
                n, b = grams.get(g, (0, 0.5 * letter(c[i]) * letter(c[i + 1]) * letter(c[i + 2]) + 0.5 / SIZE))
                grams[g] = n + 1, b
        if not grams:
            continue
        n = np.array([x for x, _ in grams.values()], float)
        best = None
        for size in range(1, len(langs) + 1):
            for chosen in combinations(langs, size):
                p = np.array([[chance(k, g) for g in grams] for k in chosen] + [[b for _, b in grams.values()]])
                pi = np.full(len(p), 1 / len(p))
                for _ in range(2000):
                    pi = pi * (p @ (n / (pi @ p))) / n.sum()
                worth = n @ np.log(pi @ p) - 2.0 * size * np.log(n.sum())
                if best is None or worth > best[0]:
                    best = worth, dict(zip(chosen, pi)), 1 - pi[-1]
        assert {m.lang for m in got[r.doc_id].mixture} == set(best[1]), r.doc_id
        assert got[r.doc_id].lang_pred == max(best[1], key=best[1].get)
        assert got[r.doc_id].known == pytest.approx(best[2], abs=0.02)


def test_language_of_nothing_is_undetermined(odd):
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.language_id(odd).where("doc_id IN (1, 2, 3)").collect()]
    assert sorted(got) == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]


TEXTS = ["it's  a\n\nTest, isn't it? ", "a  b\tc", "x \n \n y", "é́ ﬁ İ. Σ", "<|endoftext|> a  <|endoftext|>", "no. no, no!", "　wide\xa0space ", "\x1c a\x1fb", "line\nline two\nthree.", " lead", "tail ", "1,2;3:4"]


@pytest.mark.parametrize(("file", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_chunk_table_is_exact(docs, file, drops):
    table = ChunkTable(public_tokenizers.path(file), drops)
    texts = TEXTS + [r.text for r in docs.limit(150).collect()]
    want = [e.ids for e in table.lib.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in table.encode(texts)] == want


def test_codes_give_any_token():
    ids = np.concatenate([np.random.default_rng(2).integers(0, 1 << 32, 3000, dtype=np.uint64), np.arange(2000)]).astype(np.uint32)
    codes = token_codes.Codes(*token_codes.pack(ids))
    at = np.array([0, 4999, 511, 512, 513, 2999, 3000, 0])
    assert (codes.get(at) == ids[at]).all() and (codes.get(np.arange(5000)) == ids).all()
    assert len(token_codes.Codes(*token_codes.pack(ids[:0]))) == 0


def test_token_file_round_trip(spark, odd, empty):
    path = token_codes.new_path(spark)
    token_codes.write_codes(odd, path, public_tokenizers.path("word_bpe_49k.json"))
    segments = token_codes.open_codes(spark, path)
    got = token_codes.documents_of(segments).orderBy("start").collect()
    lib = ChunkTable(public_tokenizers.path("word_bpe_49k.json"), True).lib
    want = []
    for d, t, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, sum(w[2] for w in want), len(ids), zlib.crc32(ids.tobytes())))
    assert [tuple(r) for r in got] == want
    asked = spark.createDataFrame([(8, 0), (8, 99), (5, 29_999), (77, 0)], "doc_id long, pos long")
    assert {(r.doc_id, r.pos): r.token for r in token_codes.tokens_at(segments, asked).collect()}.keys() == {(8, 0), (8, 99), (5, 29_999)}
    path = token_codes.new_path(spark)
    token_codes.write_codes(empty, path, public_tokenizers.path("word_bpe_49k.json"))
    assert token_codes.documents_of(token_codes.open_codes(spark, path)).count() == 0


def links_by_rule(rows, least=0.93):
    """(vec_id, label, embedding) -> other vectors linked, smallest vec_id reachable; by all pairs of distinct rows."""
    sound = sorted({(k, lab, tuple(e)) for k, e, lab in rows if k is not None and lab is not None and e and None not in e and np.isfinite(e).all() and any(e)})
    near = [[i != j and a[1] == b[1] and len(a[2]) == len(b[2]) and float(np.dot(a[2], b[2]) / np.sqrt(np.dot(a[2], a[2]) * np.dot(b[2], b[2]))) >= least for j, b in enumerate(sound)] for i, a in enumerate(sound)]
    i, j = np.nonzero(np.array(near).reshape(len(sound), len(sound)))
    root = union_labels(len(sound), i, j)
    return {v: (sum(n), sound[root[k]][0]) for k, (v, n) in enumerate(zip(sound, near))}


@pytest.mark.parametrize(("tile", "shape"), [(2048, {}), (8, {}), (2048, {"blocks": 1, "tables": 4, "scale": 1.6}), (8, {"blocks": 3, "tables": 14, "probes": 7, "scale": 2.4})])
def test_lattice_groups_against_all_pairs(spark, monkeypatch, tile, shape):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((8, 64))
    v = np.concatenate([centre[k % 8] + rng.standard_normal((1, 64)) * rng.choice([0.05, 0.15, 0.25]) for k in range(160)]).astype(np.float32)
    rows = [(k, x.tolist(), k % 2) for k, x in enumerate(v)] + [(500, v[0].tolist(), 0), (500, v[0].tolist(), 0), (501, None, 1), (502, [0.0] * 64, 1), (503, [float("nan")] * 64, 1), (504, v[0].tolist(), None), (505, [None] * 64, 0), (506, [], 0)]
    rows += [(3, v[4].tolist(), 0), (3, v[8].tolist(), 0), (600, v[0][:16].tolist(), 0), (None, v[0].tolist(), 0)]  # a vec_id with three embeddings, another length, no vec_id
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash")).withColumn("h", F.lit(1))
    want = links_by_rule(rows)
    monkeypatch.setattr(lattice, "TILE", tile)
    monkeypatch.setattr(lattice, "SKETCHES", tile // 4)
    got = {}
    for r in lattice.lattice_groups(table, **shape).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert sum(map(len, got.values())) == len(rows)
    expected = {}
    for k, e, lab in rows:
        n, c = want.get((k, lab, tuple(e or ())), (0, k)) if e is None or None not in e else (0, k)
        expected.setdefault(k, []).append((n, c, k is None or k == c))
    found, there = (sum(n for x in g.values() for n, _, _ in x) for g in (got, expected))
    print(f"recall {found / there:.4f} of {there}")
    assert 0.99 * there <= found <= there
    if found == there:
        assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in expected.items()}
    assert lattice.lattice_groups(table.limit(0)).count() == 0


def test_lattice_recall_at_the_threshold():
    """Pairs of a cosine of exactly 0.93, with the one production shape: cells and sketches together; and what is filed of a vector."""
    rng = np.random.default_rng(7)
    assert 32 * lattice.TABLES * (1 + lattice.PROBES) < 4 * 64 * 4  # bytes, against four times 64 single-precision numbers
    for dim in (16, 64, 384):
        a = lattice.units(rng.standard_normal((2000, dim)))
        r = rng.standard_normal(a.shape)
        r = lattice.units(r - (r * a).sum(1, keepdims=True) * a)
        b = 0.93 * a + np.sqrt(1 - 0.93**2) * r
        grid = lattice.lattice_for(dim, lattice.BLOCKS, lattice.TABLES, lattice.PROBES, lattice.SCALE)
        met = (grid.all_cells(a)[:, :, :, None] == grid.all_cells(b)[:, :, None, :]).any((1, 2, 3))
        near = np.bitwise_count(grid.sketch(a) ^ grid.sketch(b)).sum(1) <= lattice.signs_apart(0.93)
        print(dim, (met & near).mean())
        assert (met & near).mean() >= 0.98


def test_lattice_with_vectors_of_doubles(spark):
    e = [1.0 + 1e-12, 1.0, 0.5]
    rows = [(1, e, 0), (2, [1.0, 1.0, 0.5], 0), (3, [1.0, -1.0, 0.5], 0), (4, [1e-300, 1e-300, 5e-301], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.lattice_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}


def test_e8_decoding_finds_the_nearest_point():
    x = np.random.default_rng(0).standard_normal((200, 8)) * 2
    roots = lattice.Lattice(8, 1, 1, 1, 1.0).roots
    p = lattice.Lattice.decode(x)
    away = ((x - p) ** 2).sum(1)
    assert (away[:, None] <= ((x[:, None] - p[:, None] - roots) ** 2).sum(2) + 1e-9).all()


def test_license_labels(spark):
    rows = [(1, "Released under the MIT License. CC BY and cc by."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "nothing here"), (4, "cc")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (2, 5, 8, "cc-by", "cc-by,mit")
    assert got[2].labels == "gpl,gpl-3.0" and got[3].labels == "" and got[4].n_words == 1


def test_license_spans_hold_different_places_and_real_words(spark):
    notice = licenses.TEMPLATES[6][1].split()
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 500)
    rows = [(1, " ".join(notice[:16])), (2, "This program is " * 9 + " ".join(notice[:16])), (3, " ".join(notice[:22])), (4, "Copyright 2020 someone. " + mit.upper().replace(",", " ,\n")), (5, " ".join(mit.split()[80:]))]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "gpl-notice" not in got[1].labels and "gpl-notice" not in got[2].labels and "gpl-notice" in got[3].labels
    assert got[4].labels == "mit" and got[4].score == 1.0 and "mit" not in got[5].labels
    # a template whose k-grams hash like the text's, but with other words, is not found
    grams = licenses.template_grams(spark, [("x", "one two three four")], {}).withColumn("text", F.lit("other words here"))
    real = licenses.template_grams
    try:
        licenses.template_grams = lambda *_: grams
        assert licenses.license_spans(spark.createDataFrame([(1, "one two three four")], "doc_id long, text string"), [("x", "one two three four")], {}).where("label IS NOT NULL").count() == 0
    finally:
        licenses.template_grams = real


def test_classifier_held_out_accuracy(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = rule_ensemble.quality_scores(docs, labels).where("held_out").join(labels, "doc_id")
    assert got.where("predicted = quality").count() >= 0.95 * got.count()


def test_rules_and_scores_by_hand(spark, docs):
    """The compiled column against rules applied one by one; the weights against the lasso's optimality conditions."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(r.doc_id, r.text, labels[r.doc_id]) for r in docs.collect() if r.doc_id in labels][:250]
    stats = np.array([rule_ensemble.statistics(t) for _, t, _ in rows])
    y = np.array([q for _, _, q in rows], float)
    names = rule_ensemble.STATS
    table = spark.createDataFrame([(float(q), *map(float, s)) for (_, _, q), s in zip(rows, stats)], "label double, " + ", ".join(f"{c} double" for c in names)).coalesce(1)
    penalty = 0.01
    model = rule_ensemble.fit(table, trees=6, depth=2, penalty=penalty)
    assert model.rules and len(model.rules) <= 6 * 6

    def holds(rule):
        return np.all([(stats[:, names.index(c)] > cut) if above else (stats[:, names.index(c)] <= cut) for c, above, cut in rule], axis=0)

    total = np.full(len(y), model.bias)
    for rule, weight in model.rules:
        total += weight * holds(rule)
    for name, weight in model.linear:
        total += weight * stats[:, names.index(name)]
    score = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
    got = [r.s for r in table.select(model.score().alias("s")).collect()]
    assert np.allclose(got, score, atol=1e-9)
    for rule, weight in model.rules:  # at the optimum the gradient in a standardised feature is -penalty * sign(weight)
        x = holds(rule).astype(float)
        gradient = ((score - y) * x).mean() / x.std(ddof=1)
        assert gradient == pytest.approx(-penalty * np.sign(weight), abs=penalty * 0.3)
    assert rule_ensemble.quality_scores(docs.limit(5), spark.createDataFrame([], "doc_id long, quality int")).select("score").distinct().count() == 1


def test_piece_digests_against_the_library(spark, docs, odd, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for table in (docs.limit(120), odd):
        rows = table.select("doc_id", "text").collect()
        want = []
        for d, t in rows:
            ids = lib.encode(t or "")
            want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((lib.decode(ids) if ids else "").encode()).hexdigest()))
        got = [tuple(r) for r in sentence_pieces.piece_digests(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_packing_pieces_against_the_library(docs, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = ChunkTable(path, False).lib
    for table in (docs.limit(150), odd):
        want = []
        rows = table.select("doc_id", "text").collect()
        for d, t in rows:
            ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
            want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        got = packing.best_fit_pack(spark_of(table).createDataFrame(rows, "doc_id long, text string"), path).collect()
        assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(map(repr, want))
        assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 1024) * 1.02 + 1


def test_packing_plan_is_bounded():
    """The plan has a run for each pattern used and each length left: it does not grow with the number of pieces."""
    rng = np.random.default_rng(9)
    sizes = []
    for scale in (1, 1000):
        histogram = rng.integers(1, 50, 1025) * scale
        histogram[0] = 0
        sizes.append(len(packing.plan(histogram, 1024)))
    assert max(sizes) <= 3 * len(packing.patterns(np.arange(1, 1025), 1024)) + 1024 * 12


def test_log_perplexity_bands_and_verdicts_by_dictionaries(spark):
    """Modified Kneser-Ney by dictionaries of real n-grams, bands by plain percentiles, over a small table with two languages."""
    import random
    from collections import Counter

    rng = random.Random(4)
    tongues = {"aa": "abcdefg", "bb": "mnopqrs"}
    words = {t: ["".join(rng.choice(s) for _ in range(rng.randint(2, 6))) for _ in range(80)] for t, s in tongues.items()}
    rows = [(k, " ".join(rng.choice(words[t]) for _ in range(rng.randint(60, 140))) + "!", t) for k in range(60) for t in [("aa", "bb")[k % 2]]]
    rows += [(900, "".join(rng.choice("abcdefg ") for _ in range(500)), "aa"), (901, "mmm " * 70, "bb"), (902, None, "bb")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for tongue in tongues:
        texts = {d: t for d, t, x in rows if x == tongue and t}
        top = Counter(("\0\0\0" + t)[i : i + 4] for t in texts.values() for i in range(len(t)))
        # one symbol for each character: letters, space and mark are classes of their own here
        counts = {4: top}
        for k in (3, 2, 1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        cut, total, left = {}, {}, {}
        for k in (1, 2, 3, 4):
            of = [sum(v == i for v in counts[k].values()) for i in (1, 2, 3, 4)]
            if min(of) == 0:
                d = [0, 0.5, 0.75, 0.9]
            else:
                y = of[0] / (of[0] + 2 * of[1])
                d = [0, *(min(max(i - (i + 1) * y * of[i] / of[i - 1], 0.05), i - 0.05) for i in (1, 2, 3))]
            cut[k] = {g: d[min(v, 3)] for g, v in counts[k].items()}
            total[k], left[k] = Counter(), Counter()
            for g, v in counts[k].items():
                total[k][g[:-1]] += v
                left[k][g[:-1]] += cut[k][g]

        def p(g):
            if not g:
                return 1 / 64
            k, context = len(g), g[:-1]
            if total[k][context] == 0:
                return p(g[1:])
            n = counts[k].get(g, 0)
            return max(n - cut[k].get(g, 0), 0) / total[k][context] + left[k][context] / total[k][context] * p(g[1:])

        ppl = {d: -sum(np.log(p(("\0\0\0" + t)[i : i + 4])) for i in range(len(t))) / len(t) for d, t in texts.items()}
        for d, x in ppl.items():
            assert got[d].log_ppl == pytest.approx(x, abs=2e-4)
        base = {d: base_by_rule(t) for d, t in texts.items()}
        sound = {d for d, b in base.items() if b[0] >= 50 and 100 * b[4] <= 50 * b[0]}
        low, mid, high = np.percentile([round(ppl[d], 3) for d in sound], [25, 50, 75])
        wide = max((high - low) / 1.349, 0.02)
        for d in texts:
            assert got[d].ppl_low == pytest.approx(mid - 5 * wide, abs=5e-3) and got[d].ppl_high == pytest.approx(mid + 10 * wide, abs=1e-2)
            assert got[d].kept == (d in sound and mid - 5 * wide <= ppl[d] <= mid + 10 * wide)
    assert not got[902].kept and not got[901].kept


def test_sentence_pieces_are_exact(docs):
    words = sentence_pieces.MarkedWords(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [*TEXTS, "", "  ", "a  b ", "d▁e", "<s> </s>", "\x00", *[r.text for r in docs.limit(100).collect()]]
    ids = [words.lib.encode(t) for t in texts]
    assert words.encode(texts) == [(len(i), ",".join(map(str, i)), words.lib.decode(i)) for i in ids]


def test_packing_is_gapless_and_tight(odd, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for table, rows in ((odd, len(ODD)), (docs, docs.count())):
        got = packing.best_fit_pack(table, path).toPandas().sort_values(["sequence_id", "offset"])
        ends = got.groupby("sequence_id").length.cumsum()
        assert (ends - got.length == got.offset).all() and ends.max() <= 1024
        assert (got.piece == 0).sum() == rows
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) * 1.01 + 1
        assert (got[got.piece > 0].length == 1024).all()
    assert packing.best_fit_pack(empty, path).count() == 0


def test_plan_places_every_piece():
    histogram = np.bincount(np.random.default_rng(4).integers(1, 65, 5000), minlength=65)
    runs = packing.plan(histogram, 64)
    used = np.zeros((runs[:, 3] + runs[:, 2]).max(), int)
    for length, _, count, sequence, _ in runs:
        used[sequence : sequence + count] += length
    assert used.max() <= 64 and used.sum() == (histogram * np.arange(65)).sum()
    assert (np.bincount(runs[:, 0], runs[:, 2], minlength=65) == histogram).all()


def test_chat_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_windows.chat_digests(table).count() == 0 and chat_windows.chat_windows(table).count() == 0


def test_chat_digests_against_plain_concatenation(spark):
    odd = queries.ODD_TEXT
    turns = [(1, 0, "system", "be <kind> \\h #1: ok"), (1, 1, "user", "q" * 900), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 4, "assistant", "a" * 2000), (1, 5, None, "é\n"), (1, 5, None, "é\n"), (2, None, "assistant", ""), (None, 1, "user", "x")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    got = {r.conv_id: r for r in chat_windows.chat_digests(table).collect()}
    for conv in (1, 2, None):
        own = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        said, loss = "".join(f"{r}\n{t}\n" for r, t in own), "".join(t for r, t in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = chat_windows.chat_windows(table).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 1 and all(w.formatted.startswith("### system") for w in windows)


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, "")
        assert kept.columns == odd.columns and kept.count() <= len(ODD)
        assert stage(spark, empty, "").count() == 0
    left = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, odd, "").collect()]
    assert left.count(6) == 1 and 7 not in left


def test_pipeline_tells_rows_apart_by_themselves(spark):
    import corpus_pipeline

    a, b = "one small text about the river and its boats", "quite another matter that nobody has seen in this town before now"
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (None, "never to be found again in any book or paper", 5), (None, b, 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _own_nth long").withColumn("fp", F.lit("clash"))
    left = corpus_pipeline.drop_near_duplicates(spark, table, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(1, a), (5, b), (0, rows[4][1])])


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    said = {r.doc_id: r for r in language_id.language_id(table).collect()}
    left = {r.doc_id: r for r in table.collect() if said[r.doc_id].lang_pred != "und" and (said[r.doc_id].known >= corpus_pipeline.LEAST_KNOWN or said[r.doc_id].n_grams < corpus_pipeline.LEAST_GRAMS)}
    spoken = spark.createDataFrame([(d, said[d].lang_pred) for d in left], "doc_id long, lang string")
    judged = {r.doc_id: r for r in quality_rules.quality_rules(table.drop("lang").join(spoken, "doc_id")).collect()}
    sound = []
    for d, r in left.items():
        words, *_, repeats = base_by_rule(r.text)
        inside = judged[d].ppl_low <= judged[d].log_ppl <= judged[d].ppl_high
        if words >= corpus_pipeline.LEAST_WORDS and 100 * repeats <= 50 * words and inside:
            sound.append(d)
    sound.sort()
    fp = np.array([fingerprint_by_rule(left[d].text) for d in sound], np.uint64)
    root = union_labels(len(sound), *np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4))
    kept = [d for k, d in enumerate(sound) if root[k] == k]
    lib = ChunkTable(public_tokenizers.path("byte_bpe_50k.json"), False).lib
    want = set()
    for d in kept:
        ids = np.array([*lib.encode(left[d].text, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want |= {(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all() and (got.offset + got.length).max() <= 1024


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, docs, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    key = [c for c in ("doc_id", "vec_id", "conv_id", "item_id", "query_id", "rank") if c in got.columns]
    got, want = (x.sort_values(key).reset_index(drop=True)[sorted(got.columns)] for x in (got, want))
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in got.columns:
        assert (got[c].isna() == want[c].isna()).all() and (got[c].dropna() == want[c].dropna()).all(), c


def test_license_sql_on_odd_rows(spark, odd, tmp_path):
    """Nulls, repeated rows, spread and interrupted notices, against the SQL."""
    import duckdb

    long_notice = licenses.TEMPLATES[6][1]
    words = long_notice.split()
    rows = [
        (20, long_notice), (20, long_notice), (21, " ".join(words[:14] + ["well", "now"] + words[14:])), (22, " ".join(words[:9])), (23, f"{long_notice} {long_notice}"), (24, "x " * 5000 + "cc by cc by-nc 4.0 CC\u212aBY cc\u0130 by"),
        (25, "Released under the X MIT License"), (26, "cc  by\nall RIGHTS reserved; all rights-reserved general public license"), (27, " ".join(w + " um" for w in words)), (None, "cc by"),
    ]
    table = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    table.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op6_licenses"])
    want = sorted(map(repr, rel.fetchall()))
    got = sorted(repr(tuple(r[c] for c in rel.columns)) for r in queries.op6_licenses(spark, str(tmp_path)).collect())
    assert got == want
    assert sum("gpl-notice" in x for x in got) >= 4


def test_lattice_sql_with_links(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(6)
    centre = rng.standard_normal((5, 64))
    rows = [(k, (centre[k % 5] + rng.standard_normal(64) * 0.05).astype(np.float32).tolist(), k % 2) for k in range(60)]
    spark.createDataFrame([*rows, (99, None, 1)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(queries.ORACLE_SQL["op5_lattice"]).fetchall()}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op5_lattice(spark, str(tmp_path)).collect()} == want
    assert sum(x[0] for x in want.values()) > 100


def test_marked_words_turn_over_in_generations(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "KEPT", 3)
    table = sentence_pieces.MarkedWords(public_tokenizers.path("piece_bpe_32k.model"))
    made = []
    fill = table.fill
    monkeypatch.setattr(table, "fill", lambda words: (made.extend(words), fill(words)))
    texts = ["one two three four", "one five", "six seven one", None, "two one", "eight nine ten one", "one six"]
    got = [table.encode([t])[0] for t in texts]
    assert [[int(x) for x in ids.split(",")] if n else [] for n, ids, _ in got] == [table.lib.encode(t or "") for t in texts]
    assert made.count(" one") == 1 and made.count(" two") <= 2 and len(table) + len(table.old) <= 16


def test_a_word_put_in_does_not_hide_a_notice(spark):
    texts = ["Released under the X MIT License", "Licensed under the new Apache License, Version 2.0", "Released under the X Y MIT License", "Licensed under the Apache License, Version 1.1", "released under license the mit", "Released X under the MIT license", "all X rights reserved", "Released under the X MIT Y License"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels) for r in licenses.license_scan(rows).collect()}
    plain = spark.createDataFrame([(0, "Released under the MIT License"), (1, "Licensed under the Apache License, Version 2.0")], "doc_id long, text string")
    whole = {r.doc_id: r.labels for r in licenses.license_scan(plain).collect()}
    assert all(whole.values()) and got[0][0] == got[5][0] == whole[0] and got[1][0] == whole[1]
    assert all(got[k][0] == "" for k in (2, 3, 4, 6)) and all(b == "" for _, b in got.values())
