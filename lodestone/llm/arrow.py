"""Small helpers for operators that stream Arrow batches through Python."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and characters after which an output batch is handed on, so that memory stays bounded.
OUT_ROWS = 4096
#: Bytes of its own that a worker may keep after a task without looking for free ones among them.
KEPT = 96 << 20

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Returns what allocators keep of freed memory to the system, if this process holds over KEPT."""
    try:
        with open("/proc/self/statm") as f:
            _, resident, shared = map(int, f.read().split()[:3])
        if (resident - shared) * os.sysconf("SC_PAGE_SIZE") <= KEPT:
            return
    except OSError:
        pass
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Run) -> Run:
    """A function for mapInArrow that gives memory back when a task ends: Spark keeps workers, and what they hold, from stage to stage."""

    def leanly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return leanly


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a slice at a time: very long texts never pile up as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(column.to_pylist() for column in part.columns))


def emit(records: Iterable[tuple], schema: pa.Schema, limit: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Tuples to Arrow batches of at most limit rows."""
    held: list[tuple] = []
    for record in records:
        held.append(record)
        if len(held) >= limit:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def map_rows(df: DataFrame, function: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, arrow: pa.Schema, limit: int = OUT_ROWS) -> DataFrame:
    """mapInArrow with a function from row tuples to row tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(function(rows(batches)), arrow, limit)

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
