"""Textures of nodes: tile addressing, texel errors and rectangle packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 4096


def tiles(textures: DataFrame, side: int = TILE) -> DataFrame:
    """textures (tex, w, h) to the tiles that cover each."""
    grid = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(size) + side - 1) / side) - 1))
    cut = textures.withColumn("tx", grid("w")).withColumn("ty", grid("h"))
    return cut.select("*", F.least(F.lit(side), F.col("w") - F.col("tx") * side).alias("tile_w"), F.least(F.lit(side), F.col("h") - F.col("ty") * side).alias("tile_h"))


def pyramid(textures: DataFrame, scale: float = 0.7071, levels: int = 4) -> DataFrame:
    """textures (tex, w, h) at falling scales: (tex, level, w, h), at least one pixel a side."""
    each = textures.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    size = lambda c: F.greatest(F.floor(F.col(c) * F.pow(F.lit(scale), F.col("level"))), F.lit(1)).alias(c)
    return each.select("tex", "level", size("w"), size("h"))


def texel_error(edges: DataFrame, most: float = 10.0) -> DataFrame:
    """edges (node, edge, pixels) to (node, error): mean edge a pixel, the pixels clamped; below one pixel the edge itself."""
    p = F.least("pixels", F.lit(most))
    return edges.groupBy("node").agg(F.avg(F.when(p < 1, F.col("edge")).otherwise(F.col("edge") / p)).alias("error"))


def pack_rectangles(sizes: Sequence[tuple[int, int]], start: int = 1096, doublings: int = 5) -> tuple[int, list[tuple[int, int]]]:
    """Shelf packing into a square, doubled until all fit: (side, places in the order given)."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i][1], -sizes[i][0], i))
    side = start
    for _ in range(doublings + 1):
        places, x, y, shelf = [(0, 0)] * len(sizes), 0, 0, 0
        for i in order:
            w, h = sizes[i]
            if x + w > side:
                x, y, shelf = 0, y + shelf, 0
            if w > side or y + h > side:
                break
            places[i] = (x, y)
            x, shelf = x + w, max(shelf, h)
        else:
            return side, places
        side *= 2
    raise ValueError("the rectangles do not fit")
