"""What the operators share: batching, packed rows, tables that workers keep, words in pieces; and, from elsewhere, written tables and links."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.links import components, hot_keys, hub_join  # noqa: F401
from ..sources.tables import read_table, shared_dir, written  # noqa: F401


def by_batch(df: DataFrame, columns: list[str], schema: str, work: Callable[[pa.RecordBatch], dict], setup: Callable | None = None) -> DataFrame:
    """``work`` over the Arrow batches of ``columns`` only (so clashing extra columns never matter); it gives the columns of ``schema``."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup is not None:
            setup()
        for batch in batches:
            got = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and ``names`` beside it: what is added later can't clash with a column of ``docs``."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[docs[c] for c in names])


#: Large tables that a worker keeps from task to task; those of other operators go when one starts, as memory is for one.
TABLES: list[dict] = []


def free_tables(but: dict | None = None) -> None:
    held = [table for table in TABLES if table is not but and table]
    for table in held:
        table.clear()
    if held:
        gc.collect()
        pa.default_memory_pool().release_unused()


def text_column(schema: str, work: Callable[..., dict]) -> Callable[..., Column]:
    """``work`` as a function of string columns: a struct of ``schema`` for each row, whose other columns stay in the JVM."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def answer(columns: tuple[pa.Array, ...]) -> pa.Array:
        free_tables()
        got = work(*[c.to_pylist() for c in columns])
        return pa.StructArray.from_arrays([pa.array(got[f.name], type=f.type) for f in kind], fields=list(kind))

    def one(a: pa.Array) -> pa.Array:
        return answer((a,))

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return answer((a, b))

    made = [F.arrow_udf(f, StructType.fromDDL(schema)).asNondeterministic() for f in (one, two)]  # or the planner would run it twice
    return lambda *columns: made[len(columns) - 1](*columns)


def slabs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` in all, or one row."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        yield at, len(sizes)


def pieces_of(batches, key: str):
    """The rows of sorted ``batches`` in tables that hold whole runs of ``key``."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            part = pa.Table.from_batches([*rest, batch]).combine_chunks()
            keys = part[key].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            if cut:
                yield part.slice(0, cut).combine_chunks()
            rest = part.slice(cut).to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def runs_of(keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of more than one equal key."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    long = np.flatnonzero(np.diff(edge) > 1)
    return list(zip(edge[long].tolist(), edge[long + 1].tolist()))


#: Bytes of words: digits, lower-case letters and what is not ASCII; capitals become small, all others spaces.
_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def spaced_out(raw: bytes, size: int) -> Iterator[list[bytes]]:
    """The words (digits, ASCII letters in lower case, bytes beyond ASCII) of a UTF-8 text, in pieces of about ``size`` bytes."""
    low, at = raw.translate(_LOWERED), 0
    while at < len(low):
        end = low.find(b" ", at + size)
        end = len(low) if end < 0 else end
        if words := low[at:end].split():
            yield words
        at = end


def union_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest node of each node's component, for the undirected links a-b among nodes 0..n-1 (added to ``label``)."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
