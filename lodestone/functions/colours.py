"""Colour functions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nine stops of a perceptual map, dark to light.
STOPS = ((68, 1, 84), (71, 44, 122), (59, 81, 139), (44, 113, 142), (33, 144, 141), (39, 173, 129), (92, 200, 99), (170, 220, 50), (253, 231, 37))


def colormap(v: Column, low: float, high: float, stops: Sequence[Sequence[int]] = STOPS) -> Column:
    """array(r, g, b) of a value: clamped, linear between the stops, rounded down."""
    n = len(stops) - 1
    at = F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * n
    k = F.least(F.floor(at), F.lit(n - 1)).cast("int")
    table = F.array(*(F.array(*(F.lit(float(c)) for c in stop)) for stop in stops))
    a, b, f = F.get(table, k), F.get(table, k + 1), at - k
    return F.array(*(F.floor(F.get(a, F.lit(i)) * (1 - f) + F.get(b, F.lit(i)) * f).cast("int") for i in range(3)))


def to_differences(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Reversible transform on bytes: green, blue and red less green, modulo 256."""
    return g, F.pmod(b - g, F.lit(256)), F.pmod(r - g, F.lit(256))


def from_differences(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return F.pmod(cr + y, F.lit(256)), y, F.pmod(cb + y, F.lit(256))


def debug_colour(i: Column) -> tuple[Column, Column, Column]:
    """A stable colour of a node id."""
    return tuple((i % m * k) % 63 + 63 for m, k in ((11, 171), (16, 135), (7, 51)))


def human_bytes(n: Column) -> Column:
    """1536 is 1.5K."""
    out = F.lit(None).cast("string")
    for power, unit in enumerate("BKMGT"):
        scaled = F.round(n / float(1024**power), 1)
        out = F.when(n >= 1024**power if power else n >= 0, F.concat(scaled.cast("decimal(20,1)").cast("string"), F.lit(unit))).otherwise(out)
    return out


#: Shares of red, green and blue at the stops of the three maps that property colours use.
MAPS = {
    "viridis": ((0.267, 0.004, 0.329), (0.283, 0.141, 0.458), (0.254, 0.265, 0.530), (0.207, 0.372, 0.553), (0.164, 0.471, 0.558), (0.128, 0.567, 0.551), (0.135, 0.659, 0.518), (0.267, 0.850, 0.441), (0.477, 1.000, 0.318)),
    "spectral": ((0.619, 0.003, 0.258), (0.835, 0.243, 0.310), (0.957, 0.427, 0.263), (0.992, 0.682, 0.380), (1.000, 0.878, 0.545), (0.878, 1.000, 0.392), (0.671, 0.866, 0.204), (0.471, 0.671, 0.059), (0.267, 0.459, 0.000)),
    "plasma": ((0.050, 0.029, 0.529), (0.294, 0.001, 0.635), (0.492, 0.012, 0.603), (0.676, 0.209, 0.486), (0.830, 0.369, 0.326), (0.959, 0.566, 0.152), (0.987, 0.788, 0.071), (0.941, 0.975, 0.320)),
}


def mapped(v: Column, low: float, high: float, name: str = "viridis") -> Column:
    """array(r, g, b) of a value by a named map."""
    return colormap(v, low, high, [[255 * c for c in stop] for stop in MAPS[name]])
