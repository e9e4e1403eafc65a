"""Operators on triangle soups, indexed meshes and point clouds.

soup: (tri, node, x0..z2). verts: (vid, x, y, z). faces: (tri, i0, i1, i2). cloud: (pid, x, y, z, node).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import Vec, corner, degenerate, face_normal, vec

HISTOGRAM_BINS = 50


def drop_degenerate(soup: DataFrame) -> DataFrame:
    return soup.filter(~degenerate())


def corners(soup: DataFrame) -> DataFrame:
    """(tri, node, corner, x, y, z): three rows a triangle."""
    each = F.posexplode(F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), F.col(f"z{i}").alias("z")) for i in range(3))))
    return soup.select("tri", "node", each.alias("corner", "p")).select("tri", "node", "corner", "p.x", "p.y", "p.z")


def face_corners(faces: DataFrame) -> DataFrame:
    """(tri, corner, vid)."""
    return faces.select("tri", F.posexplode(F.array("i0", "i1", "i2")).alias("corner", "vid"))


def to_soup(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """Faces with their corners' positions: three joins on the vertex id."""
    out = faces
    for i in range(3):
        named = verts.select(F.col("vid").alias(f"i{i}"), *(F.col(c).alias(f"{c}{i}") for c in "xyz"))
        out = out.join(named, f"i{i}")
    return out


def bad_indices(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """Corners that name no vertex."""
    return face_corners(faces).join(verts.select("vid"), "vid", "left_anti")


def weld(soup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per node: (node, vid, x, y, z) of distinct positions numbered in z, y, x order, and (tri, node, i0, i1, i2)."""
    each = corners(soup)
    distinct = each.select("node", "x", "y", "z").distinct()
    verts = distinct.withColumn("vid", F.row_number().over(Window.partitionBy("node").orderBy("z", "y", "x")).cast("long") - 1)
    indexed = each.join(verts, ["node", "x", "y", "z"])
    picks = [F.max(F.when(F.col("corner") == i, F.col("vid"))).alias(f"i{i}") for i in range(3)]
    return verts.select("node", "vid", "x", "y", "z"), indexed.groupBy("tri", "node").agg(*picks)


def split_seams(wedges: DataFrame) -> DataFrame:
    """wedges (vid, tex, u, v, ..) plus svid: a vertex id for each distinct combination, in their order."""
    from lodestone.operators.scan import dense_number

    key = ["vid", "tex", "u", "v"]
    numbered = dense_number(wedges.select(*key).distinct(), *map(F.col, key), name="svid")
    same = F.lit(True)
    for c in key:
        same &= wedges[c].eqNullSafe(numbered[c])
    return wedges.join(numbered, same).select(wedges["*"], "svid")


def edge_error(soup: DataFrame) -> DataFrame:
    """(node, error): root mean square of all edges."""
    a, b, c = corner(0), corner(1), corner(2)
    total = (b - a).norm2() + (c - b).norm2() + (a - c).norm2()
    return soup.groupBy("node").agg(F.sqrt(F.sum(total) / (3 * F.count("*"))).alias("error"))


def edge_errors(soup: DataFrame) -> DataFrame:
    """(node, average, quadratic, logarithmic) edge lengths; edges of length 0 stay out of the logarithm."""
    a, b, c = corner(0), corner(1), corner(2)
    squares = soup.select("node", F.explode(F.array((b - a).norm2(), (c - b).norm2(), (a - c).norm2())).alias("d2"))
    return squares.groupBy("node").agg(F.avg(F.sqrt("d2")).alias("average"), F.sqrt(F.avg("d2")).alias("quadratic"), F.exp(F.avg(F.when(F.col("d2") > 0, F.log("d2"))) / 2).alias("logarithmic"))


def spacing_error(cloud: DataFrame) -> DataFrame:
    """(node, error): 8 sqrt(V^(2/3) / n) of the box."""
    side = lambda c: F.max(c) - F.min(c)
    return cloud.groupBy("node").agg((8 * F.sqrt(F.pow(side("x") * side("y") * side("z"), F.lit(2 / 3)) / F.count("*"))).alias("error"))


def bounding_spheres(points: DataFrame, by: str = "node") -> DataFrame:
    """(by, cx, cy, cz, radius): the box's centre and the farthest point."""
    boxes = points.groupBy(by).agg(*(((F.min(c) + F.max(c)) / 2).alias(f"c{c}") for c in "xyz"))
    far = points.join(boxes, by).withColumn("d", (vec("x", "y", "z") - vec("cx", "cy", "cz")).norm())
    return far.groupBy(by, "cx", "cy", "cz").agg(F.max("d").alias("radius"))


def vertex_normals(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): unit sums of face normals, each weighted by its area."""
    n = face_normal(corner(0), corner(1), corner(2))
    each = to_soup(faces, verts).select(F.explode(F.array("i0", "i1", "i2")).alias("vid"), n.x.alias("nx"), n.y.alias("ny"), n.z.alias("nz"))
    summed = each.groupBy("vid").agg(*(F.sum(c).alias(c) for c in ("nx", "ny", "nz")))
    u = vec("nx", "ny", "nz").unit()
    return summed.select("vid", u.x.alias("nx"), u.y.alias("ny"), u.z.alias("nz"))


def normal_cones(normals: DataFrame) -> DataFrame:
    """normals (node, nx, ny, nz) to (node, ax, ay, az, threshold): mean axis, and the sine bound of the bin that holds 95 % of the angles; null threshold if too wide."""
    sums = normals.groupBy("node").agg(*(F.sum(c).alias(f"s{c}") for c in ("nx", "ny", "nz")), F.count("*").alias("n"))
    u = vec("snx", "sny", "snz").unit()
    axes = sums.select("node", "n", u.x.alias("ax"), u.y.alias("ay"), u.z.alias("az"))
    angle = F.acos(F.least(F.greatest(vec("nx", "ny", "nz").unit().dot(vec("ax", "ay", "az")), F.lit(-1.0)), F.lit(1.0)))
    bins = normals.join(axes, "node").withColumn("bin", F.least(F.floor(angle / F.pi() * HISTOGRAM_BINS), F.lit(HISTOGRAM_BINS - 1)))
    counted = bins.groupBy("node", "n", "ax", "ay", "az", "bin").count()
    running = F.sum("count").over(Window.partitionBy("node").orderBy("bin"))
    enough = counted.withColumn("seen", running).filter(F.col("seen") >= 0.95 * F.col("n"))
    found = enough.groupBy("node", "ax", "ay", "az").agg(F.min("bin").alias("bin"))
    alpha = F.pi() * (F.col("bin") + 1) / HISTOGRAM_BINS
    return found.select("node", "ax", "ay", "az", "bin", F.when(alpha < F.pi() / 2 - 0.1, 1 / F.cos(F.pi() / 2 - alpha)).alias("threshold"))


def anchors(points: DataFrame, axes: DataFrame) -> DataFrame:
    """(node, low, high): support points' offsets along a node's axis."""
    along = vec("x", "y", "z").dot(vec("ax", "ay", "az"))
    return points.join(axes, "node").groupBy("node").agg(F.min(along).alias("low"), F.max(along).alias("high"))


def summary(soup: DataFrame) -> DataFrame:
    """(node, nface, nvert, min and max): one row a node."""
    each = corners(soup)
    boxes = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("min_", F.min), ("max_", F.max))]
    return each.groupBy("node").agg(F.countDistinct("tri").alias("nface"), F.countDistinct("x", "y", "z").alias("nvert"), *boxes)


def signed_boundary(faces: DataFrame) -> DataFrame:
    """Vertices whose signed sum of neighbour indices is not 0: those on a border."""
    ring = F.array(*(F.struct(F.col(f"i{i}").alias("vid"), (F.col(f"i{(i + 1) % 3}") - F.col(f"i{(i + 2) % 3}")).alias("d")) for i in range(3)))
    return faces.select(F.explode(ring).alias("r")).groupBy("r.vid").agg(F.sum("r.d").alias("s")).filter("s != 0").select("vid")


def opposite_edges(faces: DataFrame) -> DataFrame:
    """(tri, edge, other_tri, other_edge): half-edges and the half-edge of opposite direction, null on a border."""
    half = F.posexplode(F.array(*(F.struct(F.col(f"i{i}").alias("a"), F.col(f"i{(i + 1) % 3}").alias("b")) for i in range(3))))
    edges = faces.select("tri", half.alias("edge", "e")).select("tri", "edge", "e.a", "e.b")
    other = edges.select(F.col("tri").alias("other_tri"), F.col("edge").alias("other_edge"), F.col("a").alias("b"), F.col("b").alias("a"))
    return edges.join(other, ["a", "b"], "left").select("tri", "edge", "other_tri", "other_edge")


def patch_runs(faces: DataFrame) -> DataFrame:
    """faces (block, src) to (block, src, ntri, tri_end): runs by source node with running end offsets."""
    counted = faces.groupBy("block", "src").agg(F.count("*").alias("ntri"))
    return counted.withColumn("tri_end", F.sum("ntri").over(Window.partitionBy("block").orderBy("src")))


def stride_keep(cloud: DataFrame, target: Column) -> DataFrame:
    """cloud (node, pid) with kept: about target points of each node, evenly strided by pid."""
    w = Window.partitionBy("node")
    i = F.row_number().over(w.orderBy("pid")) - 1
    step = F.count("*").over(w) / target
    numbered = cloud.withColumn("_i", i).withColumn("_step", F.greatest(step, F.lit(1.0)))
    return numbered.withColumn("kept", F.floor(F.ceil(F.col("_i") / F.col("_step")) * F.col("_step")) == F.col("_i")).drop("_i", "_step")


def stream_order(rows: DataFrame, i: str = "tri") -> DataFrame:
    """rows plus level: element i goes to level ctz(i); levels stream from sparse to dense."""
    from lodestone.functions.bits import trailing_zeros

    return rows.withColumn("level", trailing_zeros(F.col(i)))


def border_normals(rows: DataFrame) -> DataFrame:
    """rows (node, leaf, x, y, z, nx, ny, nz): a shared position gets the mean normal of leaves, inner nodes copy that of the highest node."""
    w = Window.partitionBy("x", "y", "z")
    mean = [F.avg(F.when(F.col("leaf"), F.col(c))).over(w).alias(f"m{c}") for c in ("nx", "ny", "nz")]
    top = [F.first(c).over(w.orderBy(F.desc("node"))).alias(f"t{c}") for c in ("nx", "ny", "nz")]
    found = rows.select("*", *mean, *top)
    out = [F.when(F.col("leaf"), F.col(f"m{c}")).otherwise(F.col(f"t{c}")).alias(c) for c in ("nx", "ny", "nz")]
    return found.select("node", "leaf", "x", "y", "z", *out)


def overlapping_boxes(boxes: DataFrame, cell: float, inflate: Column | float = 0.0) -> DataFrame:
    """(a, b) of nodes whose boxes (min_x.. max_z) overlap: an equi-join on grid cells, then the exact test."""
    lo = {c: F.col(f"min_{c}") - inflate for c in "xyz"}
    hi = {c: F.col(f"max_{c}") + inflate for c in "xyz"}
    cells = boxes.select("node", *(lo[c].alias(f"min_{c}") for c in "xyz"), *(hi[c].alias(f"max_{c}") for c in "xyz"))
    for c in "xyz":
        cells = cells.withColumn(f"g{c}", F.explode(F.sequence(F.floor(F.col(f"min_{c}") / cell), F.floor(F.col(f"max_{c}") / cell))))
    other = cells.select(F.col("node").alias("b"), *(F.col(f"{m}_{c}").alias(f"o{m}_{c}") for m in ("min", "max") for c in "xyz"), "gx", "gy", "gz")
    hit = F.lit(True)
    for c in "xyz":
        hit &= (F.col(f"min_{c}") <= F.col(f"omax_{c}")) & (F.col(f"omin_{c}") <= F.col(f"max_{c}"))
    return cells.join(other, ["gx", "gy", "gz"]).filter((F.col("node") < F.col("b")) & hit).select(F.col("node").alias("a"), "b").distinct()


def face_components(faces: DataFrame) -> DataFrame:
    """(vid, component): connected components of vertices, by the least vertex id."""
    from lodestone.operators.graph import components

    edges = faces.select(F.explode(F.array(F.struct(F.col("i0").alias("a"), F.col("i1").alias("b")), F.struct(F.col("i1").alias("a"), F.col("i2").alias("b")))).alias("e")).select("e.a", "e.b")
    return components(edges).withColumnRenamed("id", "vid")


def locked_faces(soup: DataFrame, boxes: DataFrame) -> DataFrame:
    """Faces with a corner outside their block's semi-open box; boxes (node, min_x.. max_z)."""
    out = F.lit(False)
    for i in range(3):
        for c in "xyz":
            out |= (F.col(f"{c}{i}") < F.col(f"min_{c}")) | (F.col(f"{c}{i}") >= F.col(f"max_{c}"))
    return soup.join(boxes, "node").select("tri", "node", out.alias("locked"))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return face_normal(a, b, c).norm() / 2


def texel_weight(u: tuple[Column, Column, Column], v: tuple[Column, Column, Column], width: Column, height: Column, weight: float = 1.0) -> Column:
    """Texels under a triangle of texture coordinates, times a weight."""
    return uv_area(u, v) * width * height * weight


def uv_area(u: tuple[Column, Column, Column], v: tuple[Column, Column, Column]) -> Column:
    return F.abs((u[1] - u[0]) * (v[2] - v[0]) - (u[2] - u[0]) * (v[1] - v[0])) / 2


def cloud_vertices(cloud: DataFrame) -> DataFrame:
    """(node, vid, x, y, z) of a cloud's points, numbered within each node by pid."""
    vid = F.row_number().over(Window.partitionBy("node").orderBy("pid")).cast("long") - 1
    return cloud.select("node", vid.alias("vid"), "x", "y", "z")


def cloud_level(cloud: DataFrame, target: Column) -> tuple[DataFrame, DataFrame]:
    """(the points that stay in their nodes, the rest that goes on to the next, coarser level)."""
    marked = stride_keep(cloud, target)
    return marked.filter("kept").drop("kept"), marked.filter("not kept").drop("kept")


def tight_radii(nodes: DataFrame, verts: DataFrame) -> DataFrame:
    """nodes (node, cx, cy, cz, radius) with radius at least the distance of the farthest of verts (node, x, y, z)."""
    far = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0)))
    reach = verts.join(nodes.select("node", "cx", "cy", "cz"), "node").groupBy("node").agg(F.max(far).alias("_far"))
    return nodes.join(reach, "node", "left").withColumn("radius", F.greatest("radius", "_far")).drop("_far")


def scene_layout(instances: DataFrame, side: int) -> DataFrame:
    """instances (instance from 0, cx, cy, cz, radius) plus scale and the translation tx, ty, tz that sets each, scaled to a sphere of diameter 1, on a grid of that side."""
    row = F.floor(F.col("instance") / side)
    grid = {"x": F.col("instance") - row * side, "y": F.lit(0.0), "z": row}
    scale = 1 / (2 * F.col("radius"))
    return instances.select("*", scale.alias("scale"), *((at - F.col(f"c{c}") * scale).alias(f"t{c}") for c, at in grid.items()))
