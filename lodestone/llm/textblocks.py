"""Whole texts as blocks of bytes, and the hashes of their words, without a Python object a word.

A block holds consecutive texts of an Arrow batch up to a size. A text longer than that is cut
at white space into several parts of the same row, so memory stays bounded however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes in a block.
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A fixed odd base of the polynomial hash and a fixed random value for each byte.
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    up: np.ndarray = _powers(BASE, 1024)
    down: np.ndarray = _powers(_INVERSE, 1024)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(BASE, n), _powers(_INVERSE, n)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes wherever they stand."""
    up, down = _Tables.of(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value ^ (ends - starts).astype(np.uint64))


class Block(NamedTuple):
    """rows: the part's row in the batch; begins and ends: its bytes in data; last: whether the row ends with it."""

    data: np.ndarray
    rows: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    last: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    if not len(column):
        return
    data, at = utf8(column)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        if at[stop] - at[row] <= limit:
            base = at[row]
            yield Block(data[base : at[stop]], np.arange(row, stop), at[row:stop] - base, at[row + 1 : stop + 1] - base, np.ones(stop - row, bool))
            row = stop
            continue
        begin, end = int(at[row]), int(at[row + 1])  # one text over the limit
        while begin < end:
            cut = min(end, begin + limit)
            while cut < end:
                found = np.flatnonzero(SPACE[data[cut : cut + 65536]])
                if len(found):
                    cut += int(found[0])
                    break
                cut = min(end, cut + 65536)
            yield Block(data[begin:cut], np.array([row]), np.array([0]), np.array([cut - begin]), np.array([cut == end]))
            begin = cut
        row += 1


def runs(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and part index of the runs of bytes where inside holds, cut at the borders of the parts."""
    flags = np.zeros(len(block.data) + 1, bool)
    flags[:-1] = inside
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    border = block.begins[block.begins < len(block.data)]
    begin[border] = flags[border]
    starts = np.flatnonzero(begin)
    stop = flags[:-1] & (~flags[1:] | begin[1:])
    ends = np.flatnonzero(stop) + 1
    part = np.searchsorted(block.begins, starts, "right") - 1
    return starts, ends, part


def words(block: Block, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) as starts, ends, part index and 64-bit hashes; lower folds A-Z."""
    starts, ends, part = runs(block, ~SPACE[block.data])
    return starts, ends, part, span_hashes(LOWER_ASCII[block.data] if lower else block.data, starts, ends)
