"""Adaptive k-d partitioning of points and triangles, level by level."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.operators.scan import small
from lodestone.session import materialize

RATIOS = (2 / 3, 1 / 3)
#: Points of a cell that one task splits to the end.
HELD = 100_000


def longest_axis(boxes: dict[str, tuple[Column, Column]]) -> Column:
    sides = {c: hi - lo for c, (lo, hi) in boxes.items()}
    return F.when((sides["x"] >= sides["y"]) & (sides["x"] >= sides["z"]), "x").when(sides["y"] >= sides["z"], "y").otherwise("z")


def along(axis: Column) -> Column:
    return F.when(axis == "x", F.col("x")).when(axis == "y", F.col("y")).otherwise(F.col("z"))


def split_planes(points: DataFrame, ratio: float = RATIOS[0], adaptive: float = 0.333, cells: DataFrame | None = None) -> DataFrame:
    """points (cell, x, y, z) to (cell, n, axis, middle): the longest side of the contents, and the order statistic floor(n * ratio) clamped into the middle band of the cell's box.

    cells: (cell, cell_lo_x.. cell_hi_z); without it the contents' box is the cell's."""
    boxes = points.groupBy("cell").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo_", F.min), ("hi_", F.max))))
    boxes = boxes.withColumn("axis", longest_axis({c: (F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in "xyz"}))
    prefix = "" if cells is None else "cell_"
    if cells is not None:
        boxes = boxes.join(cells, "cell")
    ranked = points.join(boxes, "cell").withColumn("p", along(F.col("axis")))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("p")))
    lo, hi = (F.when(F.col("axis") == "x", F.col(f"{prefix}{s}_x")).when(F.col("axis") == "y", F.col(f"{prefix}{s}_y")).otherwise(F.col(f"{prefix}{s}_z")) for s in ("lo", "hi"))
    middle, half = (lo + hi) / 2, (hi - lo) * adaptive / 2
    picked = ranked.filter(F.col("rank") == F.floor(F.col("n") * ratio) + 1)
    return picked.select("cell", "n", "axis", F.least(F.greatest("p", middle - half), middle + half).alias("middle"))


def approximate_planes(points: DataFrame, ratio: float, adaptive: float, cap: int) -> DataFrame:
    """split_planes for cells over cap, with an approximate quantile: one aggregate, no sort of a cell's rows. axis is null where a cell's points coincide."""
    marks = [F.percentile_approx(c, ratio, 10_000).alias(f"q_{c}") for c in "xyz"]
    boxes = points.groupBy("cell").agg(F.count("*").alias("n"), *marks, *(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo_", F.min), ("hi_", F.max)))).filter(F.col("n") > cap)
    boxes = boxes.withColumn("axis", longest_axis({c: (F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in "xyz"}))
    pick = lambda s: F.when(F.col("axis") == "x", F.col(f"{s}_x")).when(F.col("axis") == "y", F.col(f"{s}_y")).otherwise(F.col(f"{s}_z"))
    middle, half = (pick("lo") + pick("hi")) / 2, (pick("hi") - pick("lo")) * adaptive / 2
    plane = F.least(F.greatest(pick("q"), middle - half), middle + half)
    return boxes.select("cell", F.when(pick("hi") > pick("lo"), F.col("axis")).alias("axis"), plane.alias("middle"))


def split_cell(xyz: np.ndarray, cell: int, cap: int, adaptive: float, max_levels: int) -> np.ndarray:
    """The cell of every point of one cell, split as kd_partition does until none is over cap; negative where the levels do not suffice."""
    out = np.full(len(xyz), cell, np.int64)
    todo = [(cell, np.arange(len(xyz)))]
    while todo:
        cell, rows = todo.pop()
        if len(rows) <= cap:
            continue
        own = np.where(np.isnan(xyz[rows]), np.inf, xyz[rows])  # not a number comes last, as in SQL
        lo, hi = own.min(0), own.max(0)
        axis = int(np.argmax(np.where(hi > lo, hi - lo, 0)))  # the first of equal sides
        if not hi[axis] > lo[axis]:
            continue
        depth = cell.bit_length() - 1
        if depth >= max_levels:
            out[rows] = -cell
            continue
        at = max(math.ceil(RATIOS[depth % 2] * len(rows)) - 1, 0)
        middle, half = (lo[axis] + hi[axis]) / 2, (hi[axis] - lo[axis]) * adaptive / 2
        plane = hi[axis] if np.isinf(hi[axis]) else min(max(np.partition(own[:, axis], at)[at], middle - half), middle + half)
        right = own[:, axis] >= plane
        for side, part in ((2 * cell, rows[~right]), (2 * cell + 1, rows[right])):
            out[part] = side
            todo.append((side, part))
    return out


def kd_partition(points: DataFrame, cap: int, adaptive: float = 0.333, max_levels: int = 62, written: int = 4, held: int = HELD) -> DataFrame:
    """points (.., x, y, z) plus cell: every cell over cap is split at its plane until none is, or its points coincide.

    Cell 1 is the root, 2c and 2c + 1 the halves of c; a point on the plane goes right. Cells over
    `held` points are split a level a round, and points are written once in so many rounds; in between,
    a round is one more join with its planes. Smaller cells are split to the end by one group map."""
    held = max(held, cap)
    now = points.withColumns({"cell": F.lit(1).cast("long"), "_open": F.lit(True), "_whole": F.lit(False)})
    for level in range(max_levels):
        # only halves of the last level's cells can be over the bound
        planes = materialize(approximate_planes(now.filter("_open"), RATIOS[level % 2], adaptive, held), "planes")
        if planes.isEmpty():
            break
        split = now.join(small(planes.withColumn("_met", F.lit(True))), "cell", "left")
        right = F.when(F.col("axis").isNull(), F.col("cell")).otherwise(2 * F.col("cell") + (along(F.col("axis")) >= F.col("middle")).cast("long"))
        coincide = F.col("_whole") | (F.col("_met").isNotNull() & F.col("axis").isNull())
        now = split.withColumns({"cell": right, "_open": F.col("axis").isNotNull(), "_whole": coincide}).drop("axis", "middle", "_met")
        if level % written == written - 1:
            now = materialize(now, "cells")
    else:
        raise RuntimeError(f"cells over {held} points after {max_levels} levels")

    def finish(rows: pa.Table) -> pa.Table:
        lost = np.any([rows.column(c).is_null().to_numpy() for c in "xyz"], axis=0)  # in no cell
        xyz = np.column_stack([rows.column(c).to_numpy() for c in "xyz"]).astype(float)
        cells = np.zeros(len(xyz), np.int64)
        if (cell := rows.column("cell")[0].as_py()) is not None:
            cells[~lost] = split_cell(xyz[~lost], cell, cap, adaptive, max_levels)
        return rows.set_column(rows.schema.get_field_index("cell"), "cell", pa.array(cells, mask=lost | (cell is None)))

    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = now.filter("not _whole").select(*points.columns, "cell").repartition(partitions, "cell")  # by number: tasks of few MB stay apart
    schema = StructType([*rest.drop("cell").schema, StructField("cell", LongType())])
    done = rest.groupBy("cell").applyInArrow(finish, schema).unionByName(now.filter("_whole").select(*points.columns, "cell"))
    done = materialize(done, "cells")
    if not done.filter("cell < 0").isEmpty():
        raise RuntimeError(f"cells over {cap} points after {max_levels} levels")
    return done


def triangle_side(axis: str, middle: Column) -> Column:
    """1 (right) if at least as many corners lie at or beyond the plane as before it, counted in the cell only."""
    right = sum(((F.col(f"{axis}{i}") >= middle).cast("int") for i in range(3)), F.lit(0))
    return (right * 2 >= 3).cast("int")


def inside(lo: tuple[Column, ...], hi: tuple[Column, ...], p: tuple[Column, ...]) -> Column:
    """Semi-open containment."""
    out = F.lit(True)
    for a, b, c in zip(lo, hi, p):
        out &= (c >= a) & (c < b)
    return out


def points_in_cells(points: DataFrame, cells: DataFrame, width: float) -> DataFrame:
    """(pid, cell): a range join by grid cells of a width and the exact test; cells (cell, lo_x.. hi_z)."""
    gridded = cells
    for c in "xyz":
        gridded = gridded.withColumn(f"g{c}", F.explode(F.sequence(F.floor(F.col(f"lo_{c}") / width), F.floor(F.col(f"hi_{c}") / width))))
    keyed = points.select("*", *(F.floor(F.col(c) / width).alias(f"g{c}") for c in "xyz"))
    test = inside(*(tuple(F.col(f"{s}_{c}") for c in "xyz") for s in ("lo", "hi")), tuple(F.col(c) for c in "xyz"))
    return keyed.join(gridded, ["gx", "gy", "gz"]).filter(test).select("pid", "cell")


def occupancy(rows: DataFrame, cap: int, block: str = "node") -> DataFrame:
    """(block, used, fullness, full) of each block that holds rows."""
    used = F.count("*")
    return rows.groupBy(block).agg(used.alias("used"), (used / cap).alias("fullness"), (used >= cap).alias("full"))
