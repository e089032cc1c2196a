"""The perplexity bands judge every script and every language."""

import random

import pytest

from gridproof.llm import quality_rules

CYRILLIC = "абвгдежзиклмнопрстуфхчшщьыэюя"


def prose(rng, words, n=120):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def test_gibberish_of_a_script_is_outside_its_band(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("бвгдклмнпрст") + rng.choice("аеиоуя") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = [(k, prose(rng, words), "ru") for k in range(300)]
    shuffled = []
    for k in range(5):
        text = prose(rng, words)
        letters = [c for c in text if c.isalpha()]
        rng.shuffle(letters)
        shuffled.append((1000 + k, "".join(letters.pop() if c.isalpha() else c for c in text), "ru"))
        shuffled.append((2000 + k, "".join(rng.choice(CYRILLIC) if c.isalpha() else c for c in text), "ru"))
    table = spark.createDataFrame(rows + shuffled, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(table).collect()}
    assert not any(got[d] for d, *_ in shuffled)
    assert sum(got[d] for d, *_ in rows) >= 297


def test_classes_of_characters_in_any_script():
    for bits in quality_rules.LAYOUTS:
        table, top = quality_rules.class_table(bits, tuple(map(ord, "аб"))), 1 << bits
        assert len({int(table[ord(c)]) for c in " 　\xa0"}) == 1
        assert {int(table[ord(c)]) for c in "。、.！"} == {top - 2} and {int(table[ord(c)]) for c in "7٣〇"} == {top - 3} and {int(table[ord(c)]) for c in "😀+"} == {top - 1}
        assert table[ord("А")] == table[ord("а")] != table[ord("б")] and quality_rules.FIRST + quality_rules.letters_of(bits) <= table[ord("я")] < top - 3


@pytest.mark.parametrize("n_letters, bits", [(3000, 12), (150, 8)])
def test_noise_in_scripts_with_many_letters(spark, n_letters, bits):
    """Shuffled and random characters are outside the band of a language that writes with many letters."""
    rng = random.Random(13)
    letters = [chr(0x4E00 + k) for k in range(n_letters)]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(6000 if bits == 12 else 400)]

    def sentence(n):
        return "".join(rng.choice(words) + ("，" if k % 9 == 8 else "") for k in range(n)) + "。"

    rows = [(k, " ".join(sentence(30) for _ in range(55)), "zz") for k in range(600)]
    bad = []
    for k in range(6):
        text = rows[k][1]
        own = [c for c in text if c.isalpha()]
        rng.shuffle(own)
        bad.append((1000 + k, "".join(own.pop() if c.isalpha() else c for c in text), "zz"))
        bad.append((2000 + k, "".join(rng.choice(letters) if c.isalpha() else c for c in text), "zz"))
    table = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    assert {m: b for m, (b, _) in quality_rules.alphabets(table, quality_rules.model_column(["zz"])).items()} == {"=zz": bits}
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(table).collect()}
    assert not any(got[d] for d, *_ in bad)
    assert sum(got[d] for d, *_ in rows) >= 588


def test_every_language_has_a_band_of_its_own(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for k in range(27):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 8)
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(30 + 10 * k)]
        rows += [(100 * k + i, prose(rng, words, 100 - k), f"l{k:02}") for i in range(40)]
    rows += [(9000, prose(rng, ["some", "words", "of", "a", "small", "tongue"]), "tiny"), (9001, prose(rng, ["no", "tongue", "at", "all"]), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lang = {d: x for d, _, x in rows}
    got = {r.doc_id: r for r in quality_rules.quality_rules(table).collect()}
    assert len(got) == len(rows)
    bands = {}
    for d, r in got.items():
        bands.setdefault((r.ppl_low, r.ppl_high), set()).add(lang[d])
    assert sorted(map(len, bands.values())) == [1] * 27 + [2] and {"tiny", None} in bands.values()
    monkeypatch.setattr(quality_rules, "GROUP", 100)
    at_once = {r.doc_id: r for r in quality_rules.quality_rules(table).collect()}
    assert got == at_once
