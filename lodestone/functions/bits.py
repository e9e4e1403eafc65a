"""Integer and bit functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(size: Column, to: int = 256) -> Column:
    """The least multiple of a power of two that holds size."""
    return F.shiftleft(F.shiftright(size + (to - 1), to.bit_length() - 1), to.bit_length() - 1)


def trailing_zeros(i: Column) -> Column:
    """0 for 0."""
    i = i.cast("long")
    return F.when(i == 0, 0).otherwise(F.bit_count(i.bitwiseAND(-i) - 1))


def bit_length(i: Column) -> Column:
    """Bits of a non-negative integer; 0 for 0."""
    return F.when(i == 0, 0).otherwise(F.length(F.bin(i)))


def ilog2(i: Column) -> Column:
    """Whole binary logarithm; 0 for 0 and less."""
    return F.when(i <= 0, 0).otherwise(F.length(F.bin(i)) - 1)


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bit_length(n - 1)))


def spread(v: Column) -> Column:
    """Bit k of a 21-bit number goes to bit 3k."""
    v = v.cast("long").bitwiseAND(F.lit(0x1FFFFF).cast("long"))
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def squeeze(v: Column) -> Column:
    """The inverse of spread."""
    v = v.bitwiseAND(F.lit(0x1249249249249249).cast("long"))
    for shift, mask in ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF)):
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton(x: Column, y: Column, z: Column) -> Column:
    """The Z-order code of three numbers' last 21 bits."""
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def unmorton(code: Column) -> tuple[Column, Column, Column]:
    return squeeze(code), squeeze(F.shiftrightunsigned(code, 1)), squeeze(F.shiftrightunsigned(code, 2))


def morton_words(x: Column, y: Column, z: Column) -> Column:
    """The Z-order code of non-negative numbers of any size: codes of 21 bits each, highest first, so that arrays compare as the codes do."""
    part = lambda v, k: F.shiftright(v.cast("long"), 21 * k)
    return F.array(*(morton(part(x, k), part(y, k), part(z, k)) for k in (2, 1, 0)))


def unmorton_words(code: Column) -> tuple[Column, ...]:
    words = [unmorton(code[2 - k]) for k in range(3)]
    join = lambda low, middle, high: low.bitwiseOR(F.shiftleft(middle, 21)).bitwiseOR(F.shiftleft(high, 42))
    return tuple(join(*parts) for parts in zip(*words))


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 to 0, 1, 2, 3."""
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1).cast("long"))))


def bits_needed(v: Column) -> Column:
    """Bits n such that v lies in -2^(n-1) .. 2^(n-1) - 1, 0 for 0."""
    v = v.cast("long")
    return F.when(v == 0, 0).otherwise(bit_length(F.when(v < 0, -v - 1).otherwise(v)) + 1)


def truncate_to_grid(v: Column, q: float) -> Column:
    """Multiples of q, toward zero."""
    return q * (v / q).cast("long")
