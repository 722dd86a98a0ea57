"""Shared pieces: scratch tables in the shared folder, chunked Arrow batches, word rules."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.shared import cut, shared_folder  # noqa: F401  the operators' scratch tables

#: Words of the contracts: runs of anything but ASCII white space. `bytes.split()` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one step of a Python function holds at once.
CHUNK_BYTES = 2 << 20

#: Rows and bytes up to which a measured side may be broadcast; beyond them the callers shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def footprint(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of `df`, in one aggregation: 8 bytes for a number, its own for a text or binary, those as JSON for the rest."""
    plain = {"binary", "string"}
    of = lambda f: F.octet_length(f.name) if f.dataType.typeName() in plain else F.octet_length(F.to_json(F.struct(f.name))) if f.dataType.typeName() in {"array", "map", "struct"} else F.lit(8)
    each = reduce(lambda a, b: a + b, (F.coalesce(of(f), F.lit(0)).cast("long") for f in df.schema.fields))
    n, size = df.agg(F.count("*"), F.sum(each)).first()
    return n, size or 0


def maybe_broadcast(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows and BROADCAST_BYTES bytes; as it is otherwise, for a shuffled join.

    `rows`: their number, if rows of bounded width were counted already.
    """
    n, size = footprint(df) if rows is None else (rows, 0)
    return F.broadcast(df) if n <= most and size <= BROADCAST_BYTES else df


def spare(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """The number of words (long); null: 0. Splitting at white space leaves at most an empty string at either end."""
    text = F.coalesce(text, F.lit(""))
    gaps = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    trimmed = F.trim(gaps)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo `by`; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def slices(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of at most `most` text bytes, or one row if that is longer."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def pieces_of(text: bytes, ends: re.Pattern[bytes], most: int = CHUNK_BYTES) -> Iterator[bytes]:
    """`text` in pieces of some `most` bytes, each but the last ending with a byte that `ends` matches."""
    at = 0
    while len(text) - at > most:
        if not (found := ends.search(text, at + most - 1)):
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`run`, after which the worker gives the memory that it has freed back to the system.

    Spark keeps workers for later tasks, several beside each other; without this each would hold what its largest task took.
    """

    def then(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # GNU's
                trim(0)

    return then


def each_slice(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives `f` one bounded slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := f(part)) is not None and out.num_rows:
                    yield out

    return run


def collected(df: DataFrame) -> pa.Table:
    """A bounded result on the driver, as Arrow columns."""
    return df.toArrow()


def hashed64(words: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche over uint64 arrays (the splitmix64 rule)."""
    z = words.astype(np.uint64, copy=True)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
