"""Encoding with public tokenizer files by a table of distinct chunks that is kept for the life of a Python worker.

A text is cut only where no token of the vocabulary can cross, so its ids are the ids of its chunks in order: the
library encodes each distinct chunk once, and the ids are joined back by position. Texts with ordinary white space
(single spaces and line feeds) are cut by plain splitting; others by the vocabulary's own rule for white space.
"""

from __future__ import annotations

import os
import re
from array import array

from .common import TABLES, free_tables

#: White space as Unicode has it, which is what the vocabularies' patterns mean by \s. Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACE = SPACE.replace("\n", "").replace(" ", "")
#: What Python's split() takes for white space and the patterns do not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Chunks for a byte-level vocabulary whose words take one space before them.
SPACED = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Chunks for a vocabulary that drops white space.
BARE = re.compile(r"[^ \t\n\r]+")
#: Marks that end a chunk and never stand in one token with a letter or digit before them.
MARKS = ".,;:!?"
#: Distinct chunks in a generation (about 230 bytes each); there are two, and the older one is dropped.
KEPT = 400_000


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


BYTE_LETTERS = byte_letters()


class Ids(dict):
    """chunk -> ids as little-endian unsigned 32-bit integers, in two generations; a chunk that it lacks is encoded.

    The chunks of ``spaced`` tables are encoded with a space before them. A word of Latin letters only is one token
    to the vocabulary's pattern and goes to the library's model directly; a chunk that ends in marks is the chunk
    without them, then the marks; anything else goes through the library whole.
    """

    def __init__(self, lib, spaced: bool, marks: "Ids | None" = None):
        self.old: dict[str, bytes] = {}
        self.lib, self.model, self.space, self.marks = lib, lib.model, " " if spaced else "", self if marks is None else marks

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.made(chunk)
        self[chunk] = ids
        return ids

    def made(self, chunk: str) -> bytes:
        base = chunk.rstrip(MARKS)
        if base and len(base) < len(chunk) and base[-1].isalnum() and base[-1] < "\u0100":
            return self[base] + self.marks[chunk[len(base) :]]
        if chunk.isalpha():
            try:
                chunk.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                word = self.space + (chunk.lower() if self.lib.normalizer is not None else chunk)
                letters = word.encode().decode("latin-1").translate(BYTE_LETTERS)
                return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return array("I", self.lib.encode(self.space + chunk, add_special_tokens=False).ids).tobytes()

    def turn(self) -> None:
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()


class ChunkTable:
    """Exact ids of texts under one tokenizer file."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.drops_space = Tokenizer.from_file(path), drops_space
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.bare = Ids(self.lib, False)
        self.spaced = Ids(self.lib, True, self.bare)

    def plain(self, text: str) -> bool:
        """Whether plain splitting cuts the text where the vocabulary's rule does."""
        if self.drops_space:
            return not any(c in text for c in NOT_SPACE)
        return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1] in " \n" or any(c in text for c in ODD_SPACE))

    def one(self, text: str) -> bytes:
        get = self.bare.__getitem__
        if any(s in text for s in self.special):  # special tokens are the library's to find
            return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()
        if not self.plain(text):
            return b"".join(map(get, (BARE if self.drops_space else SPACED).findall(text)))
        if self.drops_space:
            return b"".join(map(get, text.split()))
        spaced = self.spaced.__getitem__
        lines = [line.split(" ") for line in text.split("\n")]
        return self.bare["\n"].join([(get(line[0]) if line[0] else b"") + b"".join(map(spaced, line[1:])) for line in lines])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none)."""
        self.bare.turn()
        self.spaced.turn()
        return [self.one(t) if t else b"" for t in texts]


_TABLES: dict[tuple, ChunkTable] = {}
TABLES.append(_TABLES)


def chunk_table(path: str, drops_space: bool) -> ChunkTable:
    key = (path, drops_space)
    free_tables(_TABLES)
    if key not in _TABLES:
        _TABLES[key] = ChunkTable(path, drops_space)
    return _TABLES[key]
