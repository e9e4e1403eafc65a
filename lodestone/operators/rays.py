"""Ray queries on spheres and triangles, by grid cells along the ray.

Every sphere or triangle is listed under the cells that its box, wider by half a cell, touches, in
a grid whose cells are no smaller than the box (larger boxes go to coarser grids, so there are at
most 27 cells each). A ray looks up the cell of a point in every cell's width of its way through
the scene: where it meets a box, one of these points lies within half a width. Cells are joined
by their numbers, and what shares one is tested exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import corner, ray_sphere, ray_triangle, vec
from lodestone.operators.scan import small
from lodestone.session import materialize

Box = dict[str, tuple[Column, Column]]
#: Cells of the finest grid along the scene's longest side, at most.
FINEST = 1024


def _cells(rows: DataFrame, box: Box, width: float) -> DataFrame:
    """rows with level, gx, gy, gz: the cells of each one's grid that its wider box touches."""
    side = F.greatest(*(hi - lo for lo, hi in box.values()))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(width)) / width))).cast("int")
    out = rows.withColumn("level", level)
    wide = F.pow(F.lit(2.0), F.col("level")) * width
    for c, (lo, hi) in box.items():
        out = out.withColumn(f"g{c}", F.explode(F.sequence(F.floor(lo / wide - 0.5), F.floor(hi / wide + 0.5))))
    return out


def _nearest(rays: DataFrame, rows: DataFrame, box: Box, distance: Column, key: str) -> DataFrame:
    """(ray, key, distance) of each ray's first hit. rows are written once: their extent, grids and cells each read them."""
    rows = materialize(rows, "scene")
    sides = [hi - lo for lo, hi in box.values()]
    scene = rows.agg(*(f(x).alias(f"{n}_{c}") for c, (lo, hi) in box.items() for n, f, x in (("lo", F.min, lo), ("hi", F.max, hi))), F.avg(F.greatest(*sides)).alias("mean")).first()
    if scene["mean"] is None:
        return rays.limit(0).join(rows.limit(0)).select("ray", key, F.lit(0.0).alias("distance"))
    longest = max(scene[f"hi_{c}"] - scene[f"lo_{c}"] for c in "xyz")
    width = max(2 * scene["mean"], longest / FINEST, 1e-9)
    listed = _cells(rows, box, width)
    # the stretch of each ray inside the scene's box, a little larger for rounding
    low, high = ({c: scene[f"{n}_{c}"] + s * width for c in "xyz"} for n, s in (("lo", -1), ("hi", 1)))
    near, far = F.lit(0.0), F.lit(float("inf"))
    for c in "xyz":
        o, d = F.col(f"o{c}"), F.col(f"d{c}")
        a, b = (low[c] - o) / F.nullif(d, F.lit(0.0)), (high[c] - o) / F.nullif(d, F.lit(0.0))
        within = o.between(low[c], high[c])
        near = F.greatest(near, F.coalesce(F.least(a, b), F.when(within, F.lit(0.0)).otherwise(F.lit(float("inf")))))
        far = F.least(far, F.coalesce(F.greatest(a, b), F.lit(float("inf"))))
    # directions are unit vectors: a step of a width is a width of way
    grids = listed.select("level").distinct()  # as many as sizes differ by powers of two
    ways = rays.withColumns({"_near": near, "_far": far}).filter("_near <= _far").join(small(grids))
    wide = F.pow(F.lit(2.0), F.col("level")) * width
    ways = ways.withColumn("_t", F.explode(F.sequence(F.lit(0), F.ceil((F.col("_far") - F.col("_near")) / wide).cast("int")))).withColumn("_t", F.col("_near") + F.col("_t") * wide)
    cells = ways.select(*rays.columns, "level", *(F.floor((F.col(f"o{c}") + F.col(f"d{c}") * F.col("_t")) / wide).alias(f"g{c}") for c in "xyz")).distinct()
    hits = listed.join(small(cells), ["level", "gx", "gy", "gz"]).withColumn("distance", distance).filter("distance is not null")
    return hits.groupBy("ray").agg(F.min(F.struct("distance", key)).alias("best")).select("ray", F.col(f"best.{key}").alias(key), "best.distance")


def nearest_spheres(rays: DataFrame, spheres: DataFrame) -> DataFrame:
    """rays (ray, ox.. dz, unit) and spheres (node, cx.. radius) to the first hit of each ray: (ray, node, distance)."""
    box = {c: (F.col(f"c{c}") - F.col("radius"), F.col(f"c{c}") + F.col("radius")) for c in "xyz"}
    return _nearest(rays, spheres.select("node", "cx", "cy", "cz", "radius"), box, ray_sphere(vec("ox", "oy", "oz"), vec("dx", "dy", "dz"), vec("cx", "cy", "cz"), F.col("radius")), "node")


def nearest_triangles(rays: DataFrame, soup: DataFrame, near: float = 0.0, far: float = float("inf")) -> DataFrame:
    """(ray, tri, distance) of the first triangle that each ray meets at a distance from near to far."""
    box = {c: (F.least(*(F.col(f"{c}{i}") for i in range(3))), F.greatest(*(F.col(f"{c}{i}") for i in range(3)))) for c in "xyz"}
    distance = ray_triangle(vec("ox", "oy", "oz"), vec("dx", "dy", "dz"), corner(0), corner(1), corner(2))
    return _nearest(rays, soup.select("tri", *(f"{c}{i}" for i in range(3) for c in "xyz")), box, F.when(distance.between(near, far), distance), "tri")
