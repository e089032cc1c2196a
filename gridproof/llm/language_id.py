"""Language identification as a mixture: each document's language proportions by expectation-maximisation.

Every n-gram of a text is drawn from one of the learned languages or from a background that belongs to none; the
proportions that make the text likeliest are found by EM over n-gram likelihoods, and the set of languages is the one of
highest likelihood less a penalty for each more. The n-gram counts of the labelled documents are added up by Spark.
N-grams are of three real letters (any script, lower case), hashed to 2**18 places, so a language's table has one
size (1 MB) whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_tables, slabs, text_column

BITS = 18
SIZE = 1 << BITS
SLAB = 500_000
#: Languages that a model may have: every task gets 1 MB for each, and the driver holds as much again.
LANGS = 400
POINTS = 0x110000
LETTER = regex.compile(r"\p{L}")
_LOW: list[np.ndarray] = []


def letters() -> np.ndarray:
    """The lower-case code point of each letter; 0 for what is no letter."""
    if not _LOW:
        low = np.zeros(POINTS, np.uint32)
        for c in range(POINTS):
            ch = chr(c)
            if ch.isalpha():
                low[c] = ord(ch.lower()[0])
        _LOW.append(low)
    return _LOW[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of the trigram that ends at each character of all texts in a row, each text's number of characters, and the letters.

    Runs of what is no letter are as one boundary: trigrams that have two boundaries are coded 0 and do not count.
    """
    sizes = np.array([len(t or "") for t in texts], np.int64)
    c = letters()[np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    b = np.concatenate([np.zeros(1, np.uint32), c[:-1]])[: len(c)]
    b[starts] = 0
    a = np.concatenate([np.zeros(1, np.uint32), b[:-1]])[: len(c)]
    a[starts] = 0
    code = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code = np.maximum(code >> np.uint32(32 - BITS), 1).astype(np.int32)
    code[((a == 0).astype(np.int8) + (b == 0) + (c == 0)) >= 2] = 0
    return code, sizes, c


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of ``docs``; letters count as well, as -1 less their code point. A task gives its own sums once."""

    def run(batches):
        free_tables()
        sums: dict[tuple[str, int], np.ndarray] = {}

        def add(key, got):
            sums[key] = sums[key] + got if key in sums else got

        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for i, j in slabs(np.array([len(t or "") for t in texts]), SLAB):
                code, sizes, c = trigrams(texts[i:j])
                for lang in set(langs[i:j]):
                    own = np.repeat(langs[i:j] == lang, sizes) & (code > 0)
                    add((lang, 0), np.bincount(code[own], minlength=SIZE))
                    add((lang, 1), np.bincount(c[own], minlength=POINTS))
        for (lang, kind), got in sums.items():
            key = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(-1 - key if kind else key, pa.int32()), pa.array(got[key], pa.int64())], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Mixture:
    """Trigram probabilities by language and of the background, and the EM over them.

    The background is what a text of no learned language looks like: half of it letters drawn one by one from all
    learned texts, half any trigram with equal chances. It is a member of every set and costs no penalty.
    """

    def __init__(self, langs: list[str], counts: np.ndarray, letter_counts: np.ndarray, weight: float = 1000.0, least: float = 0.03, penalty: float = 4.0):
        self.langs, self.least, self.penalty = langs, least, penalty
        share = (counts.sum(0) + 0.05) / (counts.sum() + 0.05 * SIZE) if len(langs) else None
        self.p = ((counts + weight * share) / (counts.sum(1, keepdims=True) + weight)).astype(np.float32) if len(langs) else counts
        self.log_letter = np.log((letter_counts + 0.5) / (letter_counts.sum() + 0.5 * POINTS)).astype(np.float32)

    def background(self, c: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The background's probability of the trigram at each character of texts that begin at ``starts``."""
        one = self.log_letter[c]
        two = np.concatenate([one[:1], one[:-1]])[: len(one)]
        two[starts] = self.log_letter[0]
        three = np.concatenate([two[:1], two[:-1]])[: len(two)]
        three[starts] = self.log_letter[0]
        return 0.5 * np.exp(one + two + three) + 0.5 / SIZE

    @staticmethod
    def proportions(p: np.ndarray, n: np.ndarray, steps: int = 100, near: float = 1e-3) -> tuple[np.ndarray, float]:
        """EM from equal shares until no share moves by ``near``: proportions of the rows of ``p``, and the log likelihood."""
        pi = np.full(len(p), 1 / len(p))
        share = n / n.sum()
        for _ in range(steps):
            new = pi * (p @ (share / (pi @ p)))
            moved = np.abs(new - pi).max()
            pi = new
            if moved < near:
                break
        return pi, float(n @ np.log(pi @ p))

    def infer(self, code: np.ndarray, background: np.ndarray) -> tuple[list[tuple[int, float]], float]:
        """(language, proportion) of the chosen set, largest first, and the background's proportion, for the trigrams of one text.

        From the languages with a share of ``least`` or more, one after another is left out, each time the one whose loss
        costs least, and the set worth most is taken.
        """
        gram, first, n = np.unique(code, return_index=True, return_counts=True)
        first, n = first[gram > 0], n[gram > 0].astype(np.float64)
        gram = gram[gram > 0]
        if not len(gram):
            return [], 1.0
        p = np.concatenate([self.p[:, gram], background[first][None, :]]).astype(np.float64)
        none = len(p) - 1

        def tried(chosen: list[int]) -> tuple[float, np.ndarray, list[int]]:
            share, fit = self.proportions(p[[*chosen, none]], n)
            return fit - self.penalty * 0.5 * len(chosen) * np.log(n.sum()), share, chosen

        pi, _ = self.proportions(p, n)
        chosen = [k for k in range(none) if pi[k] >= self.least] or [int(pi[:none].argmax())]
        best = now = tried(chosen)
        while len(now[2]) > 1:
            now = max((tried([k for k in now[2] if k != out]) for out in now[2]), key=lambda t: t[0])
            if now[0] >= best[0]:
                best = now
        shares = best[1].tolist()
        return sorted(zip(best[2], shares), key=lambda x: (-x[1], x[0])), shares[-1]


def learn(labelled: DataFrame) -> Mixture:
    """From (text, lang) rows with a language. To the driver come the sums: at most 2**18 counts and the letters of each language.

    Each value of lang is a language of its own. More than LANGS of them are an error, found before anything is gathered or
    sent: such a column holds more than languages and has to be cleaned first.
    """
    if (n_langs := labelled.agg(F.count_distinct("lang")).first()[0]) > LANGS:
        raise ValueError(f"lang has {n_langs} values; a model holds at most {LANGS} languages")
    got = count_trigrams(labelled.where("lang IS NOT NULL")).toArrow().combine_chunks()
    names, gram, n = got["lang"].to_numpy(zero_copy_only=False), got["gram"].to_numpy(), got["n"].to_numpy()
    langs, which = np.unique(names.astype(str), return_inverse=True) if len(names) else (np.zeros(0, str), np.zeros(0, int))
    counts = np.zeros((len(langs), SIZE))
    counts[which[gram >= 0], gram[gram >= 0]] = n[gram >= 0]
    letter_counts = np.bincount(-1 - gram[gram < 0], n[gram < 0], POINTS)
    return Mixture(langs.tolist(), counts, letter_counts)


def held_out(folds: int = 5) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds == 0


SCHEMA = "lang_pred string, score double, known double, n_langs int, mixture array<struct<lang: string, share: double>>, n_grams long"


def answered(model: Mixture, texts: list[str | None]) -> dict:
    """The columns of SCHEMA for some texts."""
    out = []
    for i, j in slabs(np.array([len(t or "") for t in texts]), SLAB):
        code, sizes, c = trigrams(texts[i:j])
        at = np.concatenate([[0], np.cumsum(sizes)])
        back = model.background(c, (at[:-1])[sizes > 0]) if len(c) else np.zeros(0)
        for k in range(j - i):
            known = model.langs and texts[i + k] and LETTER.search(texts[i + k])
            span = slice(at[k], at[k + 1])
            found, rest = model.infer(code[span], back[span]) if known else ([], 1.0)
            out.append((found or ([(0, 1 / len(model.langs))] if known else []), 1 - rest, int((code[span] > 0).sum())))
    return {
        "lang_pred": [model.langs[m[0][0]] if m else "und" for m, _, _ in out],
        "score": [min(1.0, m[0][1]) if m else 0.0 for m, _, _ in out],
        "known": [min(1.0, max(0.0, x)) for _, x, _ in out],
        "n_langs": [len(m) for m, _, _ in out],
        "mixture": [[{"lang": model.langs[k], "share": s} for k, s in m] for m, _, _ in out],
        "n_grams": [n for _, _, n in out],
    }


def mixture_of(text: Column, sent: Broadcast) -> Column:
    """struct of SCHEMA for each text, by the ``Mixture`` that was broadcast."""
    return text_column(SCHEMA, lambda texts: answered(sent.value, texts))(text)


def fitted(docs: DataFrame, folds: int = 5) -> Broadcast:
    """The mixture learned from all rows outside the held-out fold, for all tasks."""
    return docs.sparkSession.sparkContext.broadcast(learn(docs.where(~held_out(folds))))


def language_id(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known, n_langs, mixture (array of lang, share), n_grams (letter trigrams).

    ``lang_pred`` is the language with the largest share of the document (on a tie the first by name), ``score`` that
    share, ``known`` the share of all learned languages together: what is left is the background's, so that gibberish
    and texts of other languages have a low ``known``. Learned from rows with a language outside the held-out fold; a null
    doc_id is in no fold and isn't learned from. A text with a letter but without a trigram ("a") says nothing: it gets the
    first language by name, with a score of 1 / languages, a ``known`` of 0 and an empty mixture's n_langs of 1. More than LANGS
    values of lang are an error. A null text, one without a letter, or a table to learn from that is
    empty gives ``und``, score 0 and an empty mixture. Repeated rows are each answered; other columns are neither read
    nor returned.
    """
    held = F.coalesce(held_out(folds), F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, mixture_of(F.col("text"), fitted(docs, folds)).alias("v")).select("doc_id", "held_out", "v.*")
