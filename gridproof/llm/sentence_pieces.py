"""SentencePiece encoding and decoding by a table of distinct marked words.

In a vocabulary whose pieces never have a white-space marker after another character, no piece crosses from one
marked word (markers and what follows them) into the next. Each distinct marked word is segmented by the library
once for as long as a Python worker's table keeps it, and ids and decoded text are joined back by position.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TABLES, by_batch, free_tables, slabs

MARK = "▁"
WORD = re.compile(r" +[^ ]*")
#: Distinct words in a generation (about 300 bytes each); there are two, and the older one is dropped.
KEPT = 300_000


class MarkedWords(dict):
    """marked word (with spaces for markers) -> (number of ids, ids in decimal joined by commas, decoded text)."""

    def __init__(self, model: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(crossing.search(self.lib.id_to_piece(i)) for i in range(self.lib.get_piece_size()) if not self.lib.is_control(i)):
            raise ValueError("pieces of this model cross white-space markers")
        self.lone = [self.lib.piece_to_id(MARK)]
        self.old: dict[str, tuple[int, str, str]] = {}

    def fill(self, words: list[str]) -> None:
        """The library puts a marker before what it gets, so a word goes in without its first."""
        ids = self.lib.encode([w[1:] for w in words], num_threads=1)
        ids = [i or self.lone for i in ids]
        for w, i, back in zip(words, ids, self.lib.decode(ids, num_threads=1)):
            self[w] = (len(i), ",".join(map(str, i)), " " + back)

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text; null is empty."""
        cut = [WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self) > KEPT:  # the words of the generation before last go
            self.old = dict(self)
            self.clear()
        new = {w for ws in cut for w in ws if w not in self}
        self.update((w, self.old[w]) for w in new & self.old.keys())
        if new := list(new - self.old.keys()):
            self.fill(new)
        out = []
        for words in cut:
            got = [self[w] for w in words]
            out.append((sum(g[0] for g in got), ",".join([g[1] for g in got]), "".join([g[2] for g in got])[1:]))
        return out


_WORDS: dict[str, MarkedWords] = {}
TABLES.append(_WORDS)


def marked_words(model: str) -> MarkedWords:
    free_tables(_WORDS)
    if model not in _WORDS:
        _WORDS[model] = MarkedWords(model)
    return _WORDS[model]


def _by_slab(batch: pa.RecordBatch, model: str):
    texts = batch.column(1).to_pylist()
    for a, b in slabs(np.array([len(t or "") for t in texts]), 500_000):
        yield from marked_words(model).encode(texts[a:b])


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array), decoded. Null and empty texts have no ids; repeated rows are each encoded."""

    def work(batch: pa.RecordBatch) -> dict:
        got = list(_by_slab(batch, model))
        return {"doc_id": batch.column(0), "ids": [[int(x) for x in g[1].split(",")] if g[0] else [] for g in got], "decoded": [g[2] for g in got]}

    return by_batch(docs, ["doc_id", "text"], "doc_id long, ids array<int>, decoded string", work)


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, as ``encode_pieces`` gives ids and decoded text.

    Null and empty texts: no ids, digests of nothing. A null doc_id stays null; an empty table gives an empty result;
    repeated rows are each encoded; other columns are neither read nor returned.
    """

    def work(batch: pa.RecordBatch) -> dict:
        n, ids, decoded = [], [], []
        for count, text, back in _by_slab(batch, model):
            n.append(count)
            ids.append(hashlib.sha256(text.encode()).hexdigest())
            decoded.append(hashlib.sha256(back.encode()).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return by_batch(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
