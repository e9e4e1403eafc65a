"""Three-component vector arithmetic on flat columns: stays inside whole-stage code generation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    def __sub__(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def plus(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def times(self, s: Column | float) -> Vec:
        return Vec(self.x * s, self.y * s, self.z * s)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm2())

    def unit(self) -> Vec:
        """Divided by its length; a zero vector stays zero."""
        n = self.norm()
        safe = F.when(n > 0, n).otherwise(F.lit(1.0))
        return Vec(self.x / safe, self.y / safe, self.z / safe)


def vec(*names: str) -> Vec:
    return Vec(*(F.col(n) for n in names))


def corner(i: int) -> Vec:
    """Corner i of a triangle in columns x{i}, y{i}, z{i}."""
    return vec(f"x{i}", f"y{i}", f"z{i}")


def face_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    """Twice the area long."""
    return (b - a).cross(c - a)


def degenerate() -> Column:
    """Two corners share a position."""
    same = lambda i, j: (F.col(f"x{i}") == F.col(f"x{j}")) & (F.col(f"y{i}") == F.col(f"y{j}")) & (F.col(f"z{i}") == F.col(f"z{j}"))
    return same(0, 1) | same(1, 2) | same(0, 2)


def transform(m: list[float], p: Vec) -> Vec:
    """A 4x4 matrix, row by row, applied to a point."""
    return Vec(*(m[4 * i] * p.x + m[4 * i + 1] * p.y + m[4 * i + 2] * p.z + m[4 * i + 3] for i in range(3)))


def ray_sphere(origin: Vec, direction: Vec, centre: Vec, radius: Column) -> Column:
    """Distance along a unit ray to a sphere: 0 from inside, null if it misses or lies behind."""
    to = centre - origin
    along = to.dot(direction)
    gap2 = to.norm2() - along * along
    inside = to.norm2() <= radius * radius
    hit = (along >= 0) & (gap2 <= radius * radius)
    return F.when(inside, 0.0).when(hit, along - F.sqrt(F.greatest(radius * radius - gap2, F.lit(0.0))))


def ray_triangle(origin: Vec, direction: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Distance along a ray to a triangle, from either side; null if it misses or lies behind."""
    e1, e2 = b - a, c - a
    p = direction.cross(e2)
    det = e1.dot(p)
    s = origin - a
    q = s.cross(e1)
    u, v, t = s.dot(p) / det, direction.dot(q) / det, e2.dot(q) / det
    return F.when((F.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def matrix_product(a: Column, b: Column) -> Column:
    """The product of two 4 x 4 matrices, arrays of 16 by rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: sum((F.get(a, F.floor(i / 4).cast("int") * 4 + k) * F.get(b, i % 4 + 4 * k) for k in range(4)), F.lit(0.0)))


def matrix_inverse(m: Column) -> Column:
    """The inverse of a 4 x 4 matrix, an array of 16 by rows; null if it has none. By its 2 x 2 minors."""
    at = lambda r, c: F.get(m, F.lit(4 * r + c))
    minor = lambda r, s, c, d: at(r, c) * at(s, d) - at(r, d) * at(s, c)
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    up, low = {p: minor(0, 1, *p) for p in pairs}, {p: minor(2, 3, *p) for p in pairs}
    sign = {(0, 1): 1, (0, 2): -1, (0, 3): 1, (1, 2): 1, (1, 3): -1, (2, 3): 1}
    rest = lambda p: tuple(c for c in range(4) if c not in p)
    determinant = sum((up[p] * low[rest(p)] * sign[p] for p in pairs), F.lit(0.0))

    def cofactor(r: int, c: int) -> Column:
        """Of row r and column c: the other row of its half, times the minors of the other half."""
        other, minors = (1 - r, low) if r < 2 else (5 - r, up)
        a, b, d = (x for x in range(4) if x != c)
        total = at(other, a) * minors[(b, d)] - at(other, b) * minors[(a, d)] + at(other, d) * minors[(a, b)]
        return total if (r + c) % 2 == 0 else -total

    # the rows of a half keep their order, so the expansion's sign is that of the cofactor
    return F.when(determinant != 0, F.array(*(cofactor(r, c) / determinant for c in range(4) for r in range(4))))
