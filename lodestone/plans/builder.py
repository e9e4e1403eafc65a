"""Building a level-of-detail DAG from triangles: partition, process each block, stream the coarser rest into the next level.

Levels are a loop on the driver; each is a few joins and one group map by block, and its results
are tables in the shared folder. Blocks are bounded by the node capacity, so no group outgrows a task.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.bits import pad
from lodestone.operators import dag
from lodestone.operators.codec import coordinate_step
from lodestone.operators.mesh import cloud_level, spacing_error, tight_radii
from lodestone.operators.partition import kd_partition
from lodestone.operators.scan import dense_number
from lodestone.operators.simplify import simplify
from lodestone.session import materialize
from lodestone.sources.binary_meshes import CORNERS

SINK = -1


class BuildOptions(NamedTuple):
    node_faces: int = 32_768
    top_faces: int = 4_096
    scaling: float = 0.5
    adaptive: float = 0.333
    max_levels: int = 40


OUT = "kind string, node long, lvl int, src long, ntri long, error double, nvert long, nface long, cx double, cy double, cz double, radius double, " + ", ".join(f"{c} double" for c in CORNERS)
NAMES = [field.split()[0] for field in OUT.split(", ")]


def process(rows: pd.DataFrame, level: int, scaling: float, last: bool) -> pd.DataFrame:
    """One block: its node row, a patch row for each source, and the triangles of the coarser level."""
    node = int(rows["block"].iloc[0])
    rows = rows.sort_values(["src", *CORNERS])
    v = rows[CORNERS].to_numpy().reshape(-1, 3)
    points, index = np.unique(v, axis=0, return_inverse=True)
    faces = index.reshape(-1, 3)
    edges = np.concatenate([v[0::3] - v[1::3], v[1::3] - v[2::3], v[2::3] - v[0::3]])
    centre = (points.min(0) + points.max(0)) / 2
    own = pd.DataFrame([{"kind": "node", "error": float(np.sqrt((edges**2).sum(1).mean())), "nvert": len(points), "nface": len(faces), "cx": centre[0], "cy": centre[1], "cz": centre[2], "radius": float(np.linalg.norm(points - centre, axis=1).max())}])
    sizes = rows.groupby("src").size()
    parts = [own, pd.DataFrame({"kind": "patch", "src": sizes.index.to_numpy(), "ntri": sizes.to_numpy()})]
    if not last:
        # vertices on an edge with one face are the block's border: neighbours must still meet it there
        pairs = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), axis=1)
        each, counts = np.unique(pairs[:, 0] * len(points) + pairs[:, 1], return_counts=True)
        locked = np.zeros(len(points), bool)
        locked[np.concatenate(np.divmod(each[counts == 1], len(points)))] = True
        p, f = simplify(points, faces, max(1, int(len(faces) * scaling)), locked)
        parts.append(pd.DataFrame(p[f].reshape(-1, 9), columns=CORNERS).assign(kind="tri"))
    return pd.concat([part.reindex(columns=NAMES) for part in parts], ignore_index=True).assign(node=node, lvl=level)


def _processor(level: int, scaling: float, last: bool):
    return lambda rows: process(rows, level, scaling, last)


def _dealt(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """blocks dealt to tasks by their number: minutes of work are a few MB, which adaptive execution would put into one task."""
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(max(1, min(n_blocks, max(partitions, n_blocks // 16))), "block")


def build(soup: DataFrame, options: BuildOptions = BuildOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """soup (x0..z2) to (nodes, patches, triangles), coarse to fine, with saturated errors; the sink is the last id.

    triangles (node, dst, x0..z2) are each node's own, dst the patch that they belong to."""
    now = materialize(soup.select(F.lit(SINK).cast("long").alias("src"), *CORNERS).withColumn("tri", F.monotonically_increasing_id()), "level")
    size, base, parts, owned = now.count(), 0, [], []
    for level in range(options.max_levels):
        last = size <= options.top_faces or level == options.max_levels - 1
        middle = [((F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3).alias(c) for c in "xyz"]
        cells = kd_partition(now.select("*", *middle), options.top_faces if last else options.node_faces, options.adaptive)
        numbers = materialize(dense_number(cells.select("cell").distinct(), F.col("cell"), name="block").withColumn("block", F.col("block") + base), "numbers")
        n_blocks = numbers.count()
        blocks = materialize(cells.join(numbers, "cell").select("block", "src", *CORNERS), "triangles")
        owned.append(blocks)
        made = materialize(_dealt(blocks, n_blocks).groupBy("block").applyInPandas(_processor(level, options.scaling, last), OUT), "blocks")
        parts.append(made.filter("kind != 'tri'"))
        base += n_blocks
        now = made.filter("kind = 'tri'").select(F.col("node").alias("src"), *CORNERS)
        before, size = size, now.count()
        if last or size > 0.9 * before and n_blocks == 1:
            break
        if size > 0.9 * before:
            options = options._replace(top_faces=size)  # it does not shrink: the next level is the top
    every, triangles = reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, owned)
    sink = base
    flip = lambda c: F.when(F.col(c) == SINK, F.lit(sink)).otherwise(F.lit(base - 1) - F.col(c))
    nodes = every.filter("kind = 'node'").select(flip("node").cast("long").alias("node"), (-F.col("lvl")).alias("lvl"), "error", "cx", "cy", "cz", "radius", "nvert", "nface")
    edges = every.filter("kind = 'patch'").select(flip("node").cast("long").alias("src"), flip("src").cast("long").alias("dst"), "ntri")
    w = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    numbered = dense_number(edges, F.col("src"), F.col("dst"), name="patch")
    patches = materialize(numbered.withColumn("tri_end", F.sum("ntri").over(w)).withColumn("tri_begin", F.col("tri_end") - F.col("ntri")).drop("ntri"), "patches")
    bytes_ = pad(F.col("nvert") * 12 + F.col("nface") * 6).alias("bytes")
    own = triangles.select(flip("block").cast("long").alias("node"), flip("src").cast("long").alias("dst"), *CORNERS)
    return dag.saturate(materialize(nodes.select("*", bytes_), "nodes"), patches), patches, own


def build_cloud(points: DataFrame, options: BuildOptions = BuildOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """points (pid, x, y, z) to (nodes, patches, points), coarse to fine, with saturated errors; the sink is the last id.

    Of each block a strided share stays as its node, the rest goes on to the next, coarser level.
    points (node, dst, pid, x, y, z) holds every point once; dst is the node of the level below
    that it came from. node_faces, top_faces and scaling count points."""
    now = materialize(points.select(F.lit(SINK).cast("long").alias("src"), "pid", "x", "y", "z"), "level")
    size, base, kept = now.count(), 0, []
    for level in range(options.max_levels):
        last = size <= options.top_faces or level == options.max_levels - 1
        cells = kd_partition(now, options.top_faces if last else options.node_faces, options.adaptive)
        numbers = dense_number(cells.select("cell").distinct(), F.col("cell"), name="number")
        blocks = cells.join(numbers.select("cell", (F.col("number") + base).alias("node")), "cell").drop("cell")
        share = F.count("*").over(Window.partitionBy("node")) * (1.0 if last else 1 - options.scaling)
        stays, goes = cloud_level(materialize(blocks.withColumn("share", F.greatest(share, F.lit(1.0))), "blocks"), F.col("share"))
        kept.append(materialize(stays.withColumn("lvl", F.lit(level)).drop("share"), "points"))
        base += kept[-1].select("node").distinct().count()
        now = materialize(goes.select(F.col("node").alias("src"), "pid", "x", "y", "z"), "level")
        size = now.count()
        if not size:
            break
    every = reduce(DataFrame.unionByName, kept)
    flip = lambda c: F.when(F.col(c) == SINK, F.lit(base)).otherwise(F.lit(base - 1) - F.col(c)).cast("long")
    own = materialize(every.select(flip("node").alias("node"), flip("src").alias("dst"), "pid", "x", "y", "z", "lvl"), "points")
    box = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    sides = own.groupBy("node").agg(F.first("lvl").alias("lvl"), F.count("*").alias("nvert"), *box)
    centres = sides.select("node", (-F.col("lvl")).alias("lvl"), "nvert", F.lit(0).cast("long").alias("nface"), *(((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2).alias(f"c{c}") for c in "xyz"), F.lit(0.0).alias("radius"))
    nodes = tight_radii(centres, own).join(spacing_error(own), "node").withColumn("bytes", pad(F.col("nvert") * 12))
    w = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    edges = dense_number(own.groupBy(F.col("node").alias("src"), "dst").agg(F.count("*").alias("n")), F.col("src"), F.col("dst"), name="patch")
    patches = materialize(edges.withColumn("tri_end", F.sum("n").over(w)).withColumn("tri_begin", F.col("tri_end") - F.col("n")).drop("n"), "patches")
    return dag.saturate(materialize(nodes, "nodes"), patches), patches, own.drop("lvl")


class LodModel:
    """Nodes and patches with the selections, cuts and reports on them."""

    def __init__(self, nodes: DataFrame, patches: DataFrame, triangles: DataFrame | None = None) -> None:
        self.nodes, self.patches, self.triangles = nodes, patches, triangles

    @classmethod
    def build(cls, soup: DataFrame, options: BuildOptions = BuildOptions()) -> LodModel:
        return cls(*build(soup, options))

    @classmethod
    def open(cls, spark, path: str) -> LodModel:
        from lodestone.sources.model_file import read_patch_triangles, tables

        nodes, patches = tables(spark, path)
        return cls(nodes, patches, read_patch_triangles(spark, path, nodes, patches))

    def select(self, size: int | None = None, error: float | None = None, triangles: int | None = None, level: int | None = None, drop_last: bool = False) -> DataFrame:
        """Limits compose: a node must pass all of them."""
        out = self.nodes
        if size is not None:
            out = dag.select_budget(out, "bytes", size).drop("spent")
        if triangles is not None:
            out = dag.select_budget(out, "nface", triangles).drop("spent")
        if error is not None:
            out = dag.select_error(out, error)
        if level is not None:
            out = dag.select_level(out, self.patches, level)
        if drop_last:
            out = dag.drop_last_level(out, self.patches)
        return out

    def cut(self, selected: DataFrame) -> DataFrame:
        return dag.cut(selected, self.patches)

    def view_cut(self, view: DataFrame, error) -> DataFrame:
        """view: one row of camera columns; error: the Column of a node's screen error, held against its target."""
        return dag.view_cut(self.nodes.join(F.broadcast(view)), self.patches, error >= F.col("target"))

    def rays(self, rays: DataFrame) -> DataFrame:
        from lodestone.operators.rays import nearest_spheres

        leaves = self.patches.filter(F.col("dst") == dag.sink_of(self.patches)).select(F.col("src").alias("node"))
        return nearest_spheres(rays, self.nodes.join(leaves, "node", "left_semi"))

    def info(self) -> DataFrame:
        return dag.header(self.nodes, self.patches)

    def cut_triangles(self, selected: DataFrame) -> DataFrame:
        """(node, dst, x0..z2) to draw; only the nodes of the cut are read."""
        drawn = self.cut(selected).select(F.col("src").alias("node"), "dst")
        return self.triangles.join(drawn, ["node", "dst"], "left_semi")

    def save_stl(self, selected: DataFrame, path: str) -> int:
        from lodestone.sinks.mesh_files import write_stl

        return write_stl(self.cut_triangles(selected), path)

    def save_ply(self, selected: DataFrame, path: str) -> None:
        """One mesh with shared vertices, numbered by first use."""
        from lodestone.operators.mesh import weld
        from lodestone.sinks.mesh_files import unified, write_ply

        soup = materialize(self.cut_triangles(selected).withColumns({"tri": F.monotonically_increasing_id(), "node": F.lit(0)}), "soup")
        verts, faces = weld(soup)
        write_ply(*unified(faces, verts), path)

    def save(self, path: str, selected: DataFrame | None = None, quality: float | None = None) -> None:
        """A model file of the whole, or of a selection: ids become dense, destinations outside it the new sink.

        With a quality payloads are compressed at a step of that times half the least leaf error,
        down to a power of two. Payloads are packed a node a group on the executors and streamed into the file in order."""
        from lodestone.sinks.mesh_files import node_payloads
        from lodestone.sources import model_file as mf

        chosen = materialize((selected if selected is not None else self.nodes).select("node", "error", "cx", "cy", "cz", "radius"), "chosen")
        ids = materialize(dense_number(chosen.select("node"), F.col("node"), name="id"), "ids")
        sink = ids.count()
        dst = ids.withColumnsRenamed({"node": "dst", "id": "to"})
        mapped = self.triangles.join(ids, "node").join(dst, "dst", "left").select("id", F.coalesce("to", F.lit(sink)).alias("to"), *CORNERS)
        exponent = None
        if quality is not None:
            leaves = self.patches.filter(F.col("dst") == dag.sink_of(self.patches)).select(F.col("src").alias("node")).distinct()
            step = coordinate_step(self.nodes, leaves, quality).first()["step"]
            exponent = math.floor(math.log2(step)) if step else -10
        packed = materialize(node_payloads(mapped, exponent), "payloads")
        index = packed.withColumn("length", F.length("payload")).drop("payload").join(chosen.join(ids, "node"), "id").orderBy("id").toPandas()  # the index: a row a node, as every reader of the file holds
        nodes = np.zeros(sink, mf.NODE)
        nodes["nvert"], nodes["nface"], nodes["error"] = index["nvert"], index["nface"], index["error"]
        nodes["sphere"] = index[["cx", "cy", "cz", "radius"]]
        nodes["tight_radius"] = index["radius"]
        counts = index["dsts"].map(len).to_numpy(np.int64)
        nodes["first_patch"] = np.cumsum(counts) - counts
        patches = np.zeros(int(counts.sum()), mf.PATCH)
        patches["node"] = np.concatenate([np.asarray(x) for x in index["dsts"]])
        patches["triangle_offset"] = np.concatenate([np.asarray(x) for x in index["ends"]])
        patches["texture"] = mf.NO_TEXTURE
        centre = index[["cx", "cy", "cz"]].to_numpy()
        middle = centre.mean(0)
        reach = float((np.linalg.norm(centre - middle, axis=1) + index["radius"]).max())
        head = mf.Header(2, int(index["nvert"].sum()), int(index["nface"].sum()), mf.signature(compressed=exponent is not None), sink + 1, len(patches), 0, (*middle.tolist(), reach))
        rows = packed.select("id", "payload").repartitionByRange("id").sortWithinPartitions("id").toLocalIterator()
        mf.write(path, head, nodes, patches, (bytes(r["payload"]) for r in rows), index["length"].to_numpy())
