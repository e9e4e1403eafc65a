"""Quantisation, prediction and entropy statistics of node payloads, on columns; and the bit-level coders.

The coders (bit stream, Tunstall words, range coder) are sequential by nature and work inside one
node's payload; Spark runs them a node a row through mapInArrow.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.bits import bit_length, morton


def coordinate_step(nodes: DataFrame, leaves: DataFrame, quality: float) -> DataFrame:
    """(step, exponent): quality times half the least leaf error, and its whole binary logarithm."""
    step = F.min("error") * quality / 2
    return nodes.join(leaves, "node", "left_semi").filter("error > 0").agg(step.alias("step"), F.log2(step).cast("int").alias("exponent"))


def quantise(points: DataFrame, exponent: int, by: str = "node") -> DataFrame:
    """points plus qx, qy, qz: steps of 2^exponent above the node's least, and bits: what the widest range needs."""
    step = float(2.0**exponent)
    raw = points.select("*", *(F.floor(F.col(c) / step + 0.5).alias(f"_{c}") for c in "xyz"))
    lows = raw.groupBy(by).agg(*(F.min(f"_{c}").alias(f"_lo{c}") for c in "xyz"), *(F.max(f"_{c}").alias(f"_hi{c}") for c in "xyz"))
    joined = raw.join(lows, by)
    widest = F.greatest(*(F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in "xyz"))
    out = joined.select(*points.columns, *((F.col(f"_{c}") - F.col(f"_lo{c}")).alias(f"q{c}") for c in "xyz"), bit_length(widest).alias("bits"), *(F.col(f"_lo{c}").alias(f"lo{c}") for c in "xyz"))
    return out


def dequantise(points: DataFrame, exponent: int) -> DataFrame:
    step = float(2.0**exponent)
    return points.select("*", *(((F.col(f"q{c}") + F.col(f"lo{c}")) * step).alias(f"d{c}") for c in "xyz"))


def ordered_codes(points: DataFrame, by: str = "node", order: str = "pid") -> DataFrame:
    """One point for each distinct Morton code of a node (the first by order survives)."""
    coded = points.withColumn("code", morton(F.col("qx"), F.col("qy"), F.col("qz")))
    first = F.row_number().over(Window.partitionBy(by, "code").orderBy(order))
    return coded.withColumn("_first", first).filter("_first = 1").drop("_first")


def differing_bits(codes: DataFrame, by: str = "node") -> DataFrame:
    """codes plus diff: the highest bit in which a code differs from the one before it, null for the first."""
    before = F.lag("code").over(Window.partitionBy(by).orderBy("code"))
    return codes.withColumn("diff", bit_length(F.col("code").bitwiseXOR(before)) - 1)


def entropy(symbols: DataFrame, by: str, symbol: str) -> DataFrame:
    """(by, entropy) in bits a symbol."""
    counts = symbols.groupBy(by, symbol).count()
    total = counts.groupBy(by).agg(F.sum("count").alias("total"))
    p = F.col("count") / F.col("total")
    return counts.join(total, by).groupBy(by).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def compact_degenerate(faces: DataFrame) -> DataFrame:
    """faces (src, patch, tri, i0, i1, i2) to (patch, src, tri_end): degenerate ones dropped, offsets closed up."""
    good = faces.withColumn("keep", ((F.col("i0") != F.col("i1")) & (F.col("i1") != F.col("i2")) & (F.col("i0") != F.col("i2"))).cast("long"))
    counted = good.groupBy("src", "patch").agg(F.sum("keep").alias("n"))
    return counted.withColumn("tri_end", F.sum("n").over(Window.partitionBy("src").orderBy("patch"))).drop("n")


def octahedral(x: Column, y: Column, z: Column, unit: int) -> tuple[Column, Column]:
    """A unit normal as two integers of an octahedron's unfolding."""
    total = F.abs(x) + F.abs(y) + F.abs(z)
    u, v = x / total, y / total
    sign = lambda c: F.when(c >= 0, 1.0).otherwise(-1.0)
    fu = F.when(z < 0, (1 - F.abs(v)) * sign(u)).otherwise(u)
    fv = F.when(z < 0, (1 - F.abs(u)) * sign(v)).otherwise(v)
    return F.round(fu * unit).cast("int"), F.round(fv * unit).cast("int")


def from_octahedral(u: Column, v: Column, unit: int) -> tuple[Column, Column, Column]:
    x, y = u / float(unit), v / float(unit)
    z = 1 - F.abs(x) - F.abs(y)
    sign = lambda c: F.when(c >= 0, 1.0).otherwise(-1.0)
    fx = F.when(z < 0, (1 - F.abs(y)) * sign(x)).otherwise(x)
    fy = F.when(z < 0, (1 - F.abs(x)) * sign(y)).otherwise(y)
    n = F.sqrt(fx * fx + fy * fy + z * z)
    return fx / n, fy / n, z / n


class BitWriter:
    """Bits, most significant first; whole bytes are let go as they fill."""

    def __init__(self) -> None:
        self.done, self.value, self.n = bytearray(), 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value = self.value << bits | value & ((1 << bits) - 1)
        self.n += bits
        if self.n >= 64:
            rest = self.n % 8
            self.done += (self.value >> rest).to_bytes(self.n // 8, "big")
            self.value &= (1 << rest) - 1
            self.n = rest

    def bytes(self) -> bytes:
        rest = -self.n % 8
        return bytes(self.done) + (self.value << rest).to_bytes((self.n + rest) // 8, "big")


class BitReader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.end = raw, 0, 8 * len(raw)

    def take(self, bits: int) -> int:
        first, last = self.at // 8, (self.at + bits + 7) // 8
        self.at += bits
        if self.at > self.end:
            raise EOFError("no bits left")
        return int.from_bytes(self.raw[first:last], "big") >> 8 * last - self.at & ((1 << bits) - 1)


def write_differences(values: Sequence[int]) -> tuple[list[int], bytes]:
    """Signed values as (bit lengths of their magnitudes, bits: the rest below the top bit and a sign)."""
    out, sizes = BitWriter(), []
    for v in values:
        size = abs(v).bit_length()
        sizes.append(size)
        if size:
            out.put(abs(v) - (1 << (size - 1)), size - 1)
            out.put(v < 0, 1)
    return sizes, out.bytes()


def read_differences(sizes: Sequence[int], raw: bytes) -> list[int]:
    bits, out = BitReader(raw), []
    for size in sizes:
        v = (1 << (size - 1)) + bits.take(size - 1) if size else 0
        out.append(-v if size and bits.take(1) else v)
    return out


class Tunstall:
    """Variable-to-fixed code: up to 2^word_bits words of symbols, the likeliest grown first."""

    def __init__(self, symbols: Sequence[int], word_bits: int = 8) -> None:
        counts = Counter(symbols)
        total = sum(counts.values())
        self.probabilities = sorted(((n / total, s) for s, n in counts.items()), key=lambda x: (-x[0], x[1]))
        words = [(-p, (s,)) for p, s in self.probabilities]
        heapq.heapify(words)
        grow = len(self.probabilities) - 1
        while grow > 0 and len(words) + grow <= 1 << word_bits:
            p, word = heapq.heappop(words)
            for q, s in self.probabilities:
                heapq.heappush(words, (p * q, (*word, s)))
        self.words = sorted(w for _, w in words) if grow > 0 else [(self.probabilities[0][1],) * 1] if self.probabilities else []
        self.index = {w: i for i, w in enumerate(self.words)}
        self.prefixes = {w[:k] for w in self.words for k in range(len(w))}

    def encode(self, symbols: Sequence[int]) -> bytes:
        if len(self.probabilities) < 2:
            return b""  # one symbol: its number says all
        out, word = bytearray(), ()
        for s in symbols:
            word = (*word, s)
            if word in self.index:
                out.append(self.index[word])
                word = ()
        while word:  # any word that begins with the rest
            if word in self.index:
                out.append(self.index[word])
                break
            word = (*word, self.probabilities[0][1])
        return bytes(out)

    def decode(self, raw: bytes, n: int) -> list[int]:
        if len(self.probabilities) < 2:
            return [self.probabilities[0][1]] * n if n else []
        out: list[int] = []
        for b in raw:
            out.extend(self.words[b])
        return out[:n]


class RangeCoder:
    """Static range coder: cumulative frequencies of a total below 2^48, an interval of 64 bits that gives a byte whenever its ends agree in one."""

    WHOLE, TOP, BOTTOM = (1 << 64) - 1, 1 << 56, 1 << 48

    def __init__(self, frequencies: Sequence[int]) -> None:
        self.low = [0]
        for f in frequencies:
            self.low.append(self.low[-1] + f)
        self.total = self.low[-1]

    def narrowed(self, low: int, width: int, symbol: int) -> tuple[int, int, int]:
        """(low, width, bytes to shift out) after a symbol; a width that straddles a byte too long is cut at it."""
        unit = width // self.total
        low = (low + unit * self.low[symbol]) & self.WHOLE
        width = unit * (self.low[symbol + 1] - self.low[symbol])
        shifts = 0
        at, left = low, width
        while True:
            if at ^ (at + left) & self.WHOLE < self.TOP and at + left <= self.WHOLE:
                pass
            elif left < self.BOTTOM:
                left = -at & (self.BOTTOM - 1)
            else:
                return low, left, shifts
            at, left, shifts = (at << 8) & self.WHOLE, (left << 8) & self.WHOLE, shifts + 1

    def encode(self, symbols: Sequence[int]) -> bytes:
        low, width, out = 0, self.WHOLE, bytearray()
        for s in symbols:
            low, width, shifts = self.narrowed(low, width, s)
            for _ in range(shifts):
                out.append(low >> 56)
                low = (low << 8) & self.WHOLE
        return bytes(out) + low.to_bytes(8, "big") if len(symbols) else b""

    def decode(self, raw: bytes, n: int) -> list[int]:
        from bisect import bisect_right

        low, width, code, at, out = 0, self.WHOLE, int.from_bytes(raw[:8], "big"), 8, []
        for _ in range(n):
            place = ((code - low) & self.WHOLE) // (width // self.total)
            s = bisect_right(self.low, min(place, self.total - 1)) - 1
            out.append(s)
            low, width, shifts = self.narrowed(low, width, s)
            for _ in range(shifts):
                code = (code << 8) & self.WHOLE | (raw[at] if at < len(raw) else 0)
                low, at = (low << 8) & self.WHOLE, at + 1
        return out


def shuffled(points: DataFrame, seed: int = 0) -> DataFrame:
    """points (node, pid, ..) plus place: a 0-based random order within each node, the same for the same seed."""
    w = Window.partitionBy("node").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "node", "pid")), "pid")
    return points.withColumn("place", F.row_number().over(w) - 1)


def quantise_uv(wedges: DataFrame, exponent: int, by: str = "node") -> DataFrame:
    """wedges (by, u, v, ..) plus qu, qv: steps of 2^exponent above the node's least, and bits: what the wider range needs."""
    step = float(2.0**exponent)
    raw = wedges.select("*", *(F.floor(F.col(c) / step + 0.5).alias(f"_{c}") for c in "uv"))
    ends = raw.groupBy(by).agg(*(f(f"_{c}").alias(f"_{n}{c}") for c in "uv" for n, f in (("lo", F.min), ("hi", F.max))))
    widest = F.greatest(*(F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in "uv"))
    return raw.join(ends, by).select(*wedges.columns, *((F.col(f"_{c}") - F.col(f"_lo{c}")).alias(f"q{c}") for c in "uv"), bit_length(widest).alias("bits"))


def step_for_bits(radius: Column, bits: int) -> Column:
    """The coordinate step that gives so many bits to a model of that radius."""
    return radius / float(2**bits)


def step_exponent(step: Column) -> Column:
    """Steps are powers of two: the whole part of the logarithm."""
    return F.log2(step).cast("int")


class AlignedBytes:
    """A byte stream whose blocks are told by their length and start at multiples of four."""

    def __init__(self, raw: bytes = b"") -> None:
        self.raw, self.at = bytearray(raw), 0

    def put(self, block: bytes) -> None:
        self.raw += len(block).to_bytes(4, "little") + block
        self.raw += bytes(-len(self.raw) % 4)

    def get(self) -> bytes:
        size = int.from_bytes(self.raw[self.at : self.at + 4], "little")
        block = bytes(self.raw[self.at + 4 : self.at + 4 + size])
        if len(block) != size:
            raise ValueError("the stream ends within a block")
        self.at += 4 + size + -size % 4
        return block
