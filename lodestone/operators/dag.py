"""Level-of-detail DAGs: selection, cuts, saturation, renumbering and reports.

nodes: (node, lvl, error, cx, cy, cz, radius, nvert, nface, bytes); patches: (patch, src, dst,
tri_begin, tri_end); the sink is the last id and has no row in nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.scan import prefix_sum
from lodestone.session import materialize

GROWTH = 1.01


def sink_of(patches: DataFrame) -> int:
    return patches.agg(F.max("dst")).first()[0]


def roots(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    return nodes.join(patches.select(F.col("dst").alias("node")), "node", "left_anti")


def _raised(nodes: DataFrame, patches: DataFrame, level: str, own: list[str], child: list[str], most: Column, raised: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """nodes changed bottom-up, levels fine to coarse: raised is given a level's nodes with _most, the greatest `most` over their finer children (null without one).

    `most` reads the columns `own` of a node and `child` of its child, the latter behind an underscore.
    Edges are written once with what they need of their owner, so that each is joined at its own level only."""
    levels = [r[0] for r in nodes.select(level).distinct().collect()]  # depth of the DAG
    owners = nodes.select(F.col("node").alias("src"), F.col(level).alias("_level"), *own)
    edges = materialize(patches.select("src", "dst").join(owners, "src"), "edges")
    done = None
    for lvl in sorted(levels, reverse=True):
        here = nodes.filter(F.col(level) == lvl)
        if done is not None:
            below = done.select(F.col("node").alias("dst"), *(F.col(c).alias(f"_{c}") for c in child))
            met = edges.filter(F.col("_level") == lvl).join(below, "dst").groupBy(F.col("src").alias("node")).agg(F.max(most).alias("_most"))
            here = raised(here.join(met, "node", "left")).drop("_most")
        here = materialize(here, name)
        done = here if done is None else done.unionByName(here)
    return nodes if done is None else done


def saturate(nodes: DataFrame, patches: DataFrame, error: str = "error", level: str = "lvl") -> DataFrame:
    """nodes with error raised bottom-up: a parent not above its coarsest child gets GROWTH times that child's; levels go fine to coarse, one join each."""
    higher = F.when(F.col(error) <= F.col("_most"), F.col("_most") * GROWTH).otherwise(F.col(error))
    return _raised(nodes, patches, level, [], [error], F.col(f"_{error}"), lambda here: here.withColumn(error, higher), "saturated")


def violations(nodes: DataFrame, patches: DataFrame, error: str = "error") -> DataFrame:
    """Edges whose parent is not strictly coarser than its child."""
    pairs = patches.select("src", "dst").distinct()
    up = nodes.select(F.col("node").alias("src"), F.col(error).alias("parent_error"))
    down = nodes.select(F.col("node").alias("dst"), F.col(error).alias("child_error"))
    return pairs.join(up, "src").join(down, "dst").filter("parent_error <= child_error")


def select_budget(nodes: DataFrame, cost: str, budget: float) -> DataFrame:
    """Best-first selection under a budget: the order is (error desc, node), the first overflow ends it. Needs saturated errors."""
    return prefix_sum(nodes, cost, F.col("error"), F.col("node"), descending=True, name="spent").filter(F.col("spent") <= budget)


def select_error(nodes: DataFrame, least: float) -> DataFrame:
    return nodes.filter(F.col("error") >= least)


def first_patches(patches: DataFrame) -> DataFrame:
    """(src, dst): the destination of each node's first patch."""
    return patches.groupBy("src").agg(F.min_by("dst", "patch").alias("dst"))


def sink_distance(patches: DataFrame) -> DataFrame:
    """(node, distance) along first patches: one join a level from the sink upward."""
    first = materialize(first_patches(patches), "first")
    sink = sink_of(patches)
    found = frontier = first.sparkSession.createDataFrame([(sink, 0)], "node long, distance int")
    while True:
        frontier = materialize(first.join(frontier, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), (F.col("distance") + 1).alias("distance")), "distance")
        if frontier.isEmpty():
            return found
        found = found.union(frontier)


def select_level(nodes: DataFrame, patches: DataFrame, level: int) -> DataFrame:
    """Nodes of the first levels: level 0 are those as far from the sink as the farthest."""
    distance = sink_distance(patches)
    depth = distance.agg(F.max("distance")).first()[0]
    return nodes.join(distance, "node").filter(F.lit(depth) - F.col("distance") <= level).drop("distance")


def drop_last_level(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Without the nodes whose first patch leads to the sink."""
    last = first_patches(patches).filter(F.col("dst") == sink_of(patches)).select(F.col("src").alias("node"))
    return nodes.join(last, "node", "left_anti")


def cut(selected: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches with a selected owner and an unselected destination: the triangles to draw."""
    owner = selected.select(F.col("node").alias("src"))
    return patches.join(owner, "src", "left_semi").join(selected.select(F.col("node").alias("dst")), "dst", "left_anti")


def drawn_nodes(selected: DataFrame, patches: DataFrame) -> DataFrame:
    """Selected nodes with at least one patch in the cut."""
    return selected.join(cut(selected, patches).select(F.col("src").alias("node")), "node", "left_semi")


def count_cut(selected: DataFrame, patches: DataFrame) -> DataFrame:
    """(nodes, vertices, faces) of a cut."""
    drawn = drawn_nodes(selected, patches).agg(F.count("*").alias("nodes"), F.sum("nvert").alias("vertices"))
    return drawn.crossJoin(cut(selected, patches).agg(F.sum(F.col("tri_end") - F.col("tri_begin")).alias("faces")))  # one row each


def merged_ranges(cut_patches: DataFrame) -> DataFrame:
    """(src, tri_begin, tri_end): adjacent ranges of a node become one."""
    w = Window.partitionBy("src").orderBy("tri_begin")
    new = F.when(F.lag("tri_end").over(w) == F.col("tri_begin"), 0).otherwise(1)
    runs = cut_patches.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("src", "_run").agg(F.min("tri_begin").alias("tri_begin"), F.max("tri_end").alias("tri_end")).drop("_run")


def view_cut(nodes: DataFrame, patches: DataFrame, expandable: Column, *views: str) -> DataFrame:
    """Nodes selected by a view: expandable, and not below a node that is blocked; roots are exempt. nodes carry one view's errors, or those of several, which the columns views tell apart."""
    from lodestone.operators.graph import descendants

    judged = nodes.withColumn("_open", expandable)
    top = roots(nodes, patches).select("node")
    blocked = judged.filter(~F.col("_open")).select(*views, "node").join(top, "node", "left_anti")
    return nodes.join(descendants(patches.select("src", "dst"), blocked, *views), [*views, "node"], "left_anti")


def renumber(selected: DataFrame, patches: DataFrame) -> DataFrame:
    """(src, dst, ntri, patch) of a subset saved on its own: dense ids in order, destinations outside become the new sink."""
    from lodestone.operators.scan import dense_number

    ids = dense_number(selected.select("node"), F.col("node"), name="new")
    sink = F.broadcast(ids.agg((F.max("new") + 1).alias("sink")))  # one row
    kept = patches.join(ids.withColumnsRenamed({"node": "src", "new": "new_src"}), "src")
    mapped = kept.join(ids.withColumnsRenamed({"node": "dst", "new": "new_dst"}), "dst", "left").crossJoin(sink)
    out = mapped.select("patch", F.col("new_src").alias("src"), F.coalesce("new_dst", "sink").alias("dst"), (F.col("tri_end") - F.col("tri_begin")).alias("ntri"))
    return out


def reversed_ids(patches: DataFrame, n_nodes: int) -> DataFrame:
    """Coarse-to-fine numbering: id x becomes n - 1 - x."""
    return patches.select((F.lit(n_nodes - 1) - F.col("src")).alias("src"), (F.lit(n_nodes - 1) - F.col("dst")).alias("dst"), (F.col("tri_end") - F.col("tri_begin")).alias("ntri"))


def layout(nodes: DataFrame, index_bytes: int, padding: int = 256) -> DataFrame:
    """nodes plus offset: exclusive prefix sums of padded sizes behind the padded index, in node order."""
    from lodestone.functions.bits import pad

    placed = prefix_sum(nodes, "bytes", F.col("node"), F.col("node"), name="end")
    return placed.withColumn("offset", F.col("end") - F.col("bytes") + pad(F.lit(index_bytes), padding)).drop("end")


def header(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """One row: totals and a sphere around the roots' spheres (their box's centre, the farthest far side)."""
    top = roots(nodes, patches)
    boxes = top.agg(*(((F.min(F.col(c) - F.col("radius")) + F.max(F.col(c) + F.col("radius"))) / 2).alias(f"s{c}") for c in ("cx", "cy", "cz")))
    reach = F.sqrt(sum(((F.col(c) - F.col(f"s{c}")) * (F.col(c) - F.col(f"s{c}")) for c in ("cx", "cy", "cz")), F.lit(0.0))) + F.col("radius")
    sphere = top.crossJoin(F.broadcast(boxes)).groupBy("scx", "scy", "scz").agg(F.max(reach).alias("sradius"))
    leaves = patches.filter(F.col("dst") == sink_of(patches)).select(F.col("src").alias("node")).distinct()
    totals = nodes.join(leaves, "node", "left_semi").agg(F.sum("nvert").alias("nvert"), F.sum("nface").alias("nface"))
    sizes = nodes.agg((F.count("*") + 1).alias("n_nodes"))
    return totals.crossJoin(sizes).crossJoin(patches.agg(F.count("*").alias("n_patches"))).crossJoin(sphere)  # one row each


def levels(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """(node, level): a root's level is 0, a child's one more than that of its highest-id parent."""
    parent = materialize(patches.groupBy(F.col("dst").alias("node")).agg(F.max("src").alias("parent")).join(nodes.select("node"), "node", "left_semi"), "parents")
    found = frontier = roots(nodes, patches).select("node", F.lit(0).alias("level"))
    while True:
        frontier = materialize(parent.join(frontier.select(F.col("node").alias("parent"), "level"), "parent").select("node", (F.col("level") + 1).alias("level")), "levels")
        if frontier.isEmpty():
            return found
        found = found.union(frontier)


def adjacency(patches: DataFrame) -> DataFrame:
    """(node, children): destinations in patch order, comma-joined."""
    ordered = F.array_sort(F.collect_list(F.struct("patch", "dst")))
    return patches.groupBy(F.col("src").alias("node")).agg(F.array_join(F.transform(ordered, lambda s: s["dst"].cast("string")), ",").alias("children"))


def saturate_spheres(nodes: DataFrame, patches: DataFrame, level: str = "lvl") -> DataFrame:
    """nodes with radii raised bottom-up: a node with children reaches around their spheres, times GROWTH; levels go fine to coarse."""
    centre = ["cx", "cy", "cz"]
    reach = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in centre), F.lit(0.0))) + F.col("_radius")
    wider = F.when(F.col("_most").isNull(), F.col("radius")).otherwise(F.greatest("radius", "_most") * GROWTH)
    return _raised(nodes, patches, level, centre, [*centre, "radius"], reach, lambda here: here.withColumn("radius", wider), "spheres")


def sphere_violations(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """(src, dst) of edges whose parent's sphere does not hold the child's."""
    up = nodes.select(F.col("node").alias("src"), *(F.col(c).alias(f"p{c}") for c in ("cx", "cy", "cz", "radius")))
    down = nodes.select(F.col("node").alias("dst"), "cx", "cy", "cz", "radius")
    apart = F.sqrt(sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in ("cx", "cy", "cz")), F.lit(0.0)))
    return patches.select("src", "dst").distinct().join(up, "src").join(down, "dst").filter(apart + F.col("radius") > F.col("pradius")).select("src", "dst")


def with_root_errors(nodes: DataFrame, patches: DataFrame, radius: str = "radius") -> DataFrame:
    """nodes as a saved model has them: the error of a root is its tight radius."""
    top = roots(nodes, patches).select("node", F.lit(True).alias("_root"))
    return nodes.join(top, "node", "left").withColumn("error", F.when(F.col("_root"), F.col(radius)).otherwise(F.col("error"))).drop("_root")


def patch_dump(patches: DataFrame) -> DataFrame:
    """(patch, node, offset, triangles): where each patch of a node begins and how many triangles it has."""
    return patches.select("patch", F.col("src").alias("node"), F.col("tri_begin").alias("offset"), (F.col("tri_end") - F.col("tri_begin")).alias("triangles"))


def last_level_bytes(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """(nodes, bytes) of the nodes whose first patch leads to the sink."""
    last = first_patches(patches).filter(F.col("dst") == sink_of(patches)).select(F.col("src").alias("node"))
    return nodes.join(last, "node", "left_semi").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def client_cut(nodes: DataFrame, patches: DataFrame, target: float, budget: float, blocked_limit: int = 30, pending: int = 3, draw_share: float = 0.8) -> DataFrame:
    """(node, selected, requested) of one frame of a streaming client.

    nodes: (node, error, nvert, ready, visible), errors not rising from parent to child. Nodes are
    visited coarsest first. One is blocked if it is finer than the target (a root never is), not
    ready, below a blocked one, or if the visible nodes before it have drawn more than the budget,
    draw_share of their vertices each. The visit ends after blocked_limit blocked nodes; the first
    `pending` visited nodes that are not ready are requested."""
    from lodestone.operators.graph import descendants

    top = roots(nodes, patches).select("node", F.lit(True).alias("root"))
    judged = nodes.join(top, "node", "left").withColumn("own", ~F.col("ready") | ((F.col("error") < target) & F.col("root").isNull()))
    below = descendants(patches.select("src", "dst"), judged.filter("own").select("node")).withColumn("below", F.lit(True))
    drawn = F.when(F.col("below").isNull() & F.col("visible"), F.col("nvert") * draw_share).otherwise(0.0)
    spent = prefix_sum(judged.join(below, "node", "left").withColumn("drawn", drawn), "drawn", F.col("error"), F.col("node"), descending=True, name="spent")
    blocked = (F.col("below").isNotNull() | (F.col("spent") - F.col("drawn") > budget)).cast("long")
    counted = prefix_sum(spent.withColumn("blocked", blocked), "blocked", F.col("error"), F.col("node"), descending=True, name="so_far")
    visited = counted.filter(F.col("so_far") - F.col("blocked") < blocked_limit)
    asked = visited.filter(~F.col("ready")).orderBy(F.desc("error"), "node").limit(pending).select("node", F.lit(True).alias("asked"))
    return visited.join(asked, "node", "left").select("node", (F.col("blocked") == 0).alias("selected"), F.coalesce("asked", F.lit(False)).alias("requested"))
