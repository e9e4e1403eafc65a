"""Queries on meshes, clouds, partitions and codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import bits, colours
from lodestone.functions.vectors import corner, transform, vec
from lodestone.operators import codec, mesh, partition, payload
from lodestone.operators.scan import dense_number
from lodestone.plans.registry import At, query, r, rounded
from lodestone.sources import text_meshes

SIDES = "CASE WHEN x0 = x1 AND y0 = y1 AND z0 = z1 OR x1 = x2 AND y1 = y2 AND z1 = z2 OR x0 = x2 AND y0 = y2 AND z0 = z2 THEN 1 ELSE 0 END"
EDGE2 = """unnest([(x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0), (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)+(z2-z1)*(z2-z1), (x0-x2)*(x0-x2)+(y0-y2)*(y0-y2)+(z0-z2)*(z0-z2)])"""
CORNERS = "SELECT tri, node, unnest([0,1,2]) AS corner, unnest([x0,x1,x2]) AS x, unnest([y0,y1,y2]) AS y, unnest([z0,z1,z2]) AS z FROM"


@query("affine_ingest", "SELECT vid, round((x - 10) * 2, 5) + 0.0 AS x, round((y + 5) * 0.5, 5) + 0.0 AS y, round((z - 1) * 3, 7) + 0.0 AS z FROM {terrain_v}")
def affine_ingest(at: At) -> DataFrame:
    return at["terrain_v"].select("vid", r((F.col("x") - 10) * 2).alias("x"), r((F.col("y") + 5) * 0.5).alias("y"), r((F.col("z") - 1) * 3, 7).alias("z"))


@query("grid_quantise", "SELECT pid, round(0.05 * trunc(x / 0.05), 5) + 0.0 AS x, round(0.05 * trunc(y / 0.05), 5) + 0.0 AS y FROM {cloud}")
def grid_quantise(at: At) -> DataFrame:
    return at["cloud"].select("pid", *(r(bits.truncate_to_grid(F.col(c), 0.05)).alias(c) for c in "xy"))


@query("uv_wrap", "SELECT pid, round(CASE WHEN x * 4 = 1 THEN x * 4 ELSE (x * 4) - trunc(x * 4) END, 5) + 0.0 AS u FROM {cloud}")
def uv_wrap(at: At) -> DataFrame:
    u = F.col("x") * 4
    return at["cloud"].select("pid", r(F.when(u == 1, u).otherwise(u % 1)).alias("u"))


@query("degenerate_filter", f"SELECT tri, node FROM {{soup}} WHERE ({SIDES}) = 0")
def degenerate_filter(at: At) -> DataFrame:
    return mesh.drop_degenerate(at["soup"]).select("tri", "node")


@query("texture_offsets", "SELECT n_nationkey AS file, CAST(sum(n_regionkey + 1) OVER (ORDER BY n_nationkey) - n_regionkey - 1 AS BIGINT) AS tex_offset FROM {nation}")
def texture_offsets(at: At) -> DataFrame:
    files = at["nation"].select(F.col("n_nationkey").alias("file"), (F.col("n_regionkey") + 1).cast("long").alias("textures"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.select("file", F.coalesce(F.sum("textures").over(w), F.lit(0)).cast("long").alias("tex_offset"))


@query("bounding_box", "SELECT round(min(x),7) AS min_x, round(max(x),7) AS max_x, round(min(y),7) AS min_y, round(max(y),7) AS max_y, round(min(z),7) AS min_z, round(max(z),7) AS max_z, count(*) AS n FROM {terrain_v}")
def bounding_box(at: At) -> DataFrame:
    return at["terrain_v"].agg(*(r(f(c), 7).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n"))


@query("box_precision", "SELECT node, CAST(floor(log2(greatest(max(abs(x)), max(abs(y)), max(abs(z))) / greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)))) AS BIGINT) + 23 AS n_bits FROM {cloud} GROUP BY node")
def box_precision(at: At) -> DataFrame:
    side = F.greatest(*(F.max(c) - F.min(c) for c in "xyz"))
    return at["cloud"].groupBy("node").agg((F.floor(F.log2(F.greatest(*(F.max(F.abs(c)) for c in "xyz")) / side)) + 23).alias("n_bits"))


@query("stream_order", "SELECT tri, CAST(level AS INT) AS level, row_number() OVER (ORDER BY level DESC, tri) - 1 AS position FROM (SELECT tri, CASE WHEN tri = 0 THEN 0 ELSE bit_count((tri & -tri) - 1) END AS level FROM {terrain_f})")
def stream_order(at: At) -> DataFrame:
    placed = dense_number(mesh.stream_order(at["terrain_f"].select("tri")), -F.col("level"), F.col("tri"), name="position")
    return placed.select("tri", F.col("level").cast("int").alias("level"), "position")


@query("face_lookup", "SELECT tri, node, round(x0,7) AS x0, round(z0,7) AS z0, round(x1,7) AS x1, round(z1,7) AS z1, round(x2,7) AS x2, round(z2,7) AS z2 FROM {terrain_s}")
def face_lookup(at: At) -> DataFrame:
    out = mesh.to_soup(at["terrain_f"], at["terrain_v"].select("vid", "x", "y", "z"))
    return rounded(out.select("tri", F.floor(F.col("tri") / 500.0).alias("node"), "x0", "z0", "x1", "z1", "x2", "z2"), 7)


@query("bad_indices", "SELECT count(*) AS n FROM (SELECT unnest([i0, i1, i2]) AS vid FROM {terrain_f}) c WHERE vid NOT IN (SELECT vid FROM {terrain_v})")
def bad_indices(at: At) -> DataFrame:
    return mesh.bad_indices(at["terrain_f"], at["terrain_v"]).agg(F.count("*").alias("n"))


@query("obj_materials", """SELECT v AS tri, 'm' || CAST(floor(n / 100.0) AS BIGINT) AS material FROM (SELECT tri AS v, row_number() OVER (ORDER BY tri) - 1 AS n FROM {terrain_f})""")
def obj_materials(at: At) -> DataFrame:
    """Face lines with a material line before every hundredth, read back with the material carried forward."""
    faces = dense_number(at["terrain_f"].select("tri"), F.col("tri"), name="n")
    line = F.explode(F.when(F.col("n") % 100 == 0, F.array(F.struct((2 * F.col("n")).alias("line"), F.concat(F.lit("usemtl m"), (F.col("n") / 100).cast("long")).alias("text")), F.struct((2 * F.col("n") + 1).alias("line"), F.concat(F.lit("f "), "tri").alias("text")))).otherwise(F.array(F.struct((2 * F.col("n") + 1).alias("line"), F.concat(F.lit("f "), "tri").alias("text")))))
    lines = faces.select(line.alias("l")).select(F.lit("a.obj").alias("path"), "l.line", "l.text")
    carried = text_meshes.carry_forward(lines, r"^usemtl\s+(\S+)", "material")
    return carried.filter(F.col("text").startswith("f ")).select(F.regexp_extract("text", r"^f (\d+)", 1).cast("long").alias("tri"), "material")


@query("polygon_fans", "SELECT o_orderkey AS poly, CAST(j AS BIGINT) AS part, o_orderkey AS i0, o_orderkey + j AS i1, o_orderkey + j + 1 AS i2 FROM (SELECT o_orderkey, unnest(range(1, 1 + CAST(o_orderkey % 4 AS BIGINT) + 1)) AS j FROM {orders})")
def polygon_fans(at: At) -> DataFrame:
    poly = at["orders"].select(F.col("o_orderkey").alias("poly"), F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 4 + 2).cast("int")), lambda k: F.col("o_orderkey") + k).alias("ring"))
    return text_meshes.fan(poly, "ring").select("poly", F.col("part").cast("long").alias("part"), "i0", "i1", "i2")


@query("weld", "WITH c AS (SELECT DISTINCT node, x, y, z FROM (" + CORNERS + " {soup}) q) SELECT node, row_number() OVER (PARTITION BY node ORDER BY z, y, x) - 1 AS vid, round(x,5) AS x, round(y,5) AS y, round(z,5) AS z FROM c")
def weld(at: At) -> DataFrame:
    return rounded(mesh.weld(at["soup"])[0])


@query("welded_faces", "WITH c AS (" + CORNERS + " {soup}), v AS (SELECT node, x, y, z, row_number() OVER (PARTITION BY node ORDER BY z, y, x) - 1 AS vid FROM (SELECT DISTINCT node, x, y, z FROM c) d) SELECT tri, node, max(CASE WHEN corner = 0 THEN vid END) AS i0, max(CASE WHEN corner = 1 THEN vid END) AS i1, max(CASE WHEN corner = 2 THEN vid END) AS i2 FROM c JOIN v USING (node, x, y, z) GROUP BY tri, node")
def welded_faces(at: At) -> DataFrame:
    return mesh.weld(at["soup"])[1]


@query("edge_error", f"SELECT node, round(sqrt(avg(d2)), 4) AS error FROM (SELECT node, {EDGE2} AS d2 FROM {{terrain_s}}) GROUP BY node")
def edge_error(at: At) -> DataFrame:
    return rounded(mesh.edge_error(at["terrain_s"]), 4)


@query("edge_errors", f"SELECT node, round(avg(sqrt(d2)), 4) AS average, round(sqrt(avg(d2)), 4) AS quadratic, round(exp(avg(CASE WHEN d2 > 0 THEN ln(d2) END) / 2), 4) AS logarithmic FROM (SELECT node, {EDGE2} AS d2 FROM {{terrain_s}}) GROUP BY node")
def edge_errors(at: At) -> DataFrame:
    return rounded(mesh.edge_errors(at["terrain_s"]), 4)


@query("spacing_error", "SELECT node, round(8 * sqrt(pow((max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)), 2.0/3) / count(*)), 5) AS error FROM {cloud} GROUP BY node")
def spacing_error(at: At) -> DataFrame:
    return rounded(mesh.spacing_error(at["cloud"]))


@query("bounding_spheres", "WITH b AS (SELECT node, (min(x)+max(x))/2 AS cx, (min(y)+max(y))/2 AS cy, (min(z)+max(z))/2 AS cz FROM {cloud} GROUP BY node) SELECT node, round(cx,5)+0.0 AS cx, round(cy,5)+0.0 AS cy, round(cz,5)+0.0 AS cz, round(max(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))),5) AS radius FROM {cloud} JOIN b USING (node) GROUP BY node, cx, cy, cz")
def bounding_spheres(at: At) -> DataFrame:
    return rounded(mesh.bounding_spheres(at["cloud"]))


NORMALS = """WITH n AS (SELECT f.tri, unnest([f.i0, f.i1, f.i2]) AS vid, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS nx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS ny, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS nz FROM {terrain_f} f JOIN {terrain_s} s USING (tri)),
 t AS (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM n GROUP BY vid)"""


@query("vertex_normals", NORMALS + " SELECT vid, round(nx/sqrt(nx*nx+ny*ny+nz*nz),5)+0.0 AS nx, round(ny/sqrt(nx*nx+ny*ny+nz*nz),5)+0.0 AS ny, round(nz/sqrt(nx*nx+ny*ny+nz*nz),5)+0.0 AS nz FROM t")
def vertex_normals(at: At) -> DataFrame:
    return rounded(mesh.vertex_normals(at["terrain_f"], at["terrain_v"].select("vid", "x", "y", "z")))


CONES = """WITH s AS (SELECT node, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz, count(*) AS n FROM {cloud} GROUP BY node),
 a AS (SELECT node, n, sx/sqrt(sx*sx+sy*sy+sz*sz) AS ax, sy/sqrt(sx*sx+sy*sy+sz*sz) AS ay, sz/sqrt(sx*sx+sy*sy+sz*sz) AS az FROM s),
 b AS (SELECT node, n, ax, ay, az, least(floor(acos(least(greatest((nx*ax+ny*ay+nz*az)/sqrt(nx*nx+ny*ny+nz*nz),-1),1))/pi()*50),49) AS bin FROM {cloud} JOIN a USING (node)),
 h AS (SELECT node, n, ax, ay, az, bin, count(*) AS k FROM b GROUP BY ALL), w AS (SELECT *, sum(k) OVER (PARTITION BY node ORDER BY bin) AS seen FROM h)"""


@query("normal_cones", CONES + " SELECT node, round(ax,5)+0.0 AS ax, round(ay,5)+0.0 AS ay, round(az,5)+0.0 AS az, CAST(min(bin) AS BIGINT) AS bin FROM w WHERE seen >= 0.95*n GROUP BY node, ax, ay, az")
def normal_cones(at: At) -> DataFrame:
    return rounded(mesh.normal_cones(at["cloud"].select("node", "nx", "ny", "nz")).drop("threshold"))


@query("cone_anchors", CONES + " SELECT node, round(min(x*ax+y*ay+z*az),5)+0.0 AS low, round(max(x*ax+y*ay+z*az),5)+0.0 AS high FROM {cloud} JOIN a USING (node) GROUP BY node")
def cone_anchors(at: At) -> DataFrame:
    axes = mesh.normal_cones(at["cloud"].select("node", "nx", "ny", "nz")).select("node", "ax", "ay", "az")
    return rounded(mesh.anchors(at["cloud"], axes))


@query("cone_quantise", "SELECT pid, CAST(round(nx * 32766) AS INT) AS qx, CAST(round(least(greatest(nz * 100, -10), 10) * 3276) AS INT) AS ql FROM {cloud}")
def cone_quantise(at: At) -> DataFrame:
    from lodestone.functions.views import quantise_axis, quantise_length

    return at["cloud"].select("pid", quantise_axis(F.col("nx")).alias("qx"), quantise_length(F.col("nz") * 100).alias("ql"))


@query("node_summary", "SELECT node, count(DISTINCT tri) AS nface, count(DISTINCT (x, y, z)) AS nvert, round(min(x),7) AS min_x, round(max(x),7) AS max_x, round(min(y),7) AS min_y, round(max(y),7) AS max_y, round(min(z),7) AS min_z, round(max(z),7) AS max_z FROM (" + CORNERS + " {terrain_s}) c GROUP BY node")
def node_summary(at: At) -> DataFrame:
    return rounded(mesh.summary(at["terrain_s"]), 7)


@query("patch_runs", "SELECT block, src, count(*) AS ntri, CAST(sum(count(*)) OVER (PARTITION BY block ORDER BY src) AS BIGINT) AS tri_end FROM (SELECT l_orderkey % 50 AS block, l_suppkey AS src FROM {lineitem}) GROUP BY block, src")
def patch_runs(at: At) -> DataFrame:
    return mesh.patch_runs(at["lineitem"].select((F.col("l_orderkey") % 50).alias("block"), F.col("l_suppkey").alias("src")))


@query("split_seams", "SELECT l_orderkey AS face, l_linenumber AS corner, l_partkey AS vid, dense_rank() OVER (ORDER BY l_partkey, l_suppkey % 3, l_linenumber, l_returnflag) - 1 AS svid FROM {lineitem}")
def split_seams(at: At) -> DataFrame:
    wedges = at["lineitem"].select(F.col("l_orderkey").alias("face"), F.col("l_linenumber").alias("corner"), F.col("l_partkey").alias("vid"), (F.col("l_suppkey") % 3).alias("tex"), F.col("l_linenumber").alias("u"), F.col("l_returnflag").alias("v"))
    return mesh.split_seams(wedges).select("face", "corner", "vid", "svid")


@query("signed_boundary", "SELECT vid FROM (SELECT unnest([i0,i1,i2]) AS vid, unnest([i1-i2,i2-i0,i0-i1]) AS d FROM {terrain_f}) GROUP BY vid HAVING sum(d) <> 0")
def signed_boundary(at: At) -> DataFrame:
    return mesh.signed_boundary(at["terrain_f"])


@query("opposite_edges", "WITH e AS (SELECT tri, unnest([0,1,2]) AS edge, unnest([i0,i1,i2]) AS a, unnest([i1,i2,i0]) AS b FROM {terrain_f}) SELECT e.tri, e.edge, o.tri AS other_tri, o.edge AS other_edge FROM e LEFT JOIN e o ON o.a = e.b AND o.b = e.a")
def opposite_edges(at: At) -> DataFrame:
    return mesh.opposite_edges(at["terrain_f"])


@query("stride_decimation", "SELECT pid, node, floor(ceil(i / s) * s) = i AS kept FROM (SELECT pid, node, row_number() OVER (PARTITION BY node ORDER BY pid) - 1 AS i, greatest(CAST(count(*) OVER (PARTITION BY node) AS DOUBLE) / 10, 1) AS s FROM {cloud})")
def stride_decimation(at: At) -> DataFrame:
    return mesh.stride_keep(at["cloud"].select("pid", "node"), F.lit(10.0))


@query("border_normals", """WITH q AS (SELECT pid AS node, pid % 3 = 0 AS leaf, round(x, 1) AS x, round(y, 1) AS y, CAST(0 AS DOUBLE) AS z, nx, ny, nz FROM {cloud})
 SELECT node, leaf, round(CASE WHEN leaf THEN avg(CASE WHEN leaf THEN nx END) OVER p ELSE first_value(nx) OVER o END,5)+0.0 AS nx, round(CASE WHEN leaf THEN avg(CASE WHEN leaf THEN nz END) OVER p ELSE first_value(nz) OVER o END,5)+0.0 AS nz
 FROM q WINDOW p AS (PARTITION BY x, y, z), o AS (PARTITION BY x, y, z ORDER BY node DESC)""")
def border_normals(at: At) -> DataFrame:
    rows = at["cloud"].select(F.col("pid").alias("node"), (F.col("pid") % 3 == 0).alias("leaf"), (F.round("x", 1) + 0.0).alias("x"), (F.round("y", 1) + 0.0).alias("y"), F.lit(0.0).alias("z"), "nx", "ny", "nz")
    return rounded(mesh.border_normals(rows).select("node", "leaf", "nx", "nz"))


@query("overlapping_boxes", """WITH b AS (SELECT node, min(least(x0,x1,x2)) AS ax, max(greatest(x0,x1,x2)) AS bx, min(least(y0,y1,y2)) AS ay, max(greatest(y0,y1,y2)) AS by_, min(least(z0,z1,z2)) AS az, max(greatest(z0,z1,z2)) AS bz FROM {terrain_s} GROUP BY node)
 SELECT p.node AS a, q.node AS b FROM b p JOIN b q ON p.node < q.node AND p.ax <= q.bx AND q.ax <= p.bx AND p.ay <= q.by_ AND q.ay <= p.by_ AND p.az <= q.bz AND q.az <= p.bz""")
def overlapping_boxes(at: At) -> DataFrame:
    return mesh.overlapping_boxes(mesh.summary(at["terrain_s"]), 40.0)


@query("vertex_components", """WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey - least(o_orderkey % 37, 1) AS b FROM {orders} UNION SELECT o_orderkey - least(o_orderkey % 37, 1), o_orderkey - least(o_orderkey % 37, 2) FROM {orders}),
 w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), x AS (SELECT DISTINCT a AS vid, a AS other FROM w UNION SELECT x.vid, w.b FROM x JOIN w ON w.a = x.other) SELECT vid, min(other) AS component FROM x GROUP BY vid""")
def vertex_components(at: At) -> DataFrame:
    """Strips of faces over runs of 37 vertices: each vertex of a strip hangs on the two before it."""
    v, k = F.col("o_orderkey"), F.col("o_orderkey") % 37
    strips = at["orders"].select(v.alias("i0"), (v - F.least(k, F.lit(1))).alias("i1"), (v - F.least(k, F.lit(2))).alias("i2"))
    return mesh.face_components(strips)


@query("locked_faces", """WITH b AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(0 AS DOUBLE) AS lo, CAST(n_nationkey % 7 * 20 AS DOUBLE) AS hi FROM {nation})
 SELECT tri, node, NOT (least(x0,x1,x2) >= lo AND greatest(x0,x1,x2) < hi AND least(y0,y1,y2) >= -1 AND greatest(y0,y1,y2) < 1e9 AND least(z0,z1,z2) >= -1e9 AND greatest(z0,z1,z2) < 1e9) AS locked FROM {terrain_s} JOIN b USING (node)""")
def locked_faces(at: At) -> DataFrame:
    d = lambda c: F.lit(float(c))
    boxes = at["nation"].select(F.col("n_nationkey").cast("long").alias("node"), d(0).alias("min_x"), (F.col("n_nationkey") % 7 * 20.0).alias("max_x"), d(-1).alias("min_y"), d(1e9).alias("max_y"), d(-1e9).alias("min_z"), d(1e9).alias("max_z"))
    return mesh.locked_faces(at["terrain_s"], boxes)


@query("locked_vertices", """WITH l AS (SELECT tri, i0 % 5 = 0 AS locked, i0, i1, i2 FROM {terrain_f}) SELECT vid, bool_or(locked) AS locked FROM (SELECT unnest([i0,i1,i2]) AS vid, locked FROM l) GROUP BY vid""")
def locked_vertices(at: At) -> DataFrame:
    locked = at["terrain_f"].select("tri", (F.col("i0") % 5 == 0).alias("locked"))
    return mesh.face_corners(at["terrain_f"]).join(locked, "tri").groupBy("vid").agg(F.bool_or("locked").alias("locked"))


@query("split_planes", """WITH b AS (SELECT node AS cell, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM {cloud} GROUP BY node),
 a AS (SELECT *, CASE WHEN hx-lx >= hy-ly AND hx-lx >= hz-lz THEN 'x' WHEN hy-ly >= hz-lz THEN 'y' ELSE 'z' END AS axis FROM b),
 k AS (SELECT cell, n, axis, CASE axis WHEN 'x' THEN lx WHEN 'y' THEN ly ELSE lz END AS lo, CASE axis WHEN 'x' THEN hx WHEN 'y' THEN hy ELSE hz END AS hi, CASE axis WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END AS p FROM {cloud} c JOIN a ON a.cell = c.node),
 q AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY p) AS rank FROM k)
 SELECT cell, n, axis, round(least(greatest(p, (lo+hi)/2 - (hi-lo)*0.333/2), (lo+hi)/2 + (hi-lo)*0.333/2), 5)+0.0 AS middle FROM q WHERE rank = floor(n * 2.0 / 3) + 1""")
def split_planes(at: At) -> DataFrame:
    return rounded(partition.split_planes(at["cloud"].withColumnRenamed("node", "cell")))


@query("split_planes_in_cells", """WITH b AS (SELECT node AS cell, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM {cloud} GROUP BY node),
 a AS (SELECT *, CASE WHEN hx-lx >= hy-ly AND hx-lx >= hz-lz THEN 'x' WHEN hy-ly >= hz-lz THEN 'y' ELSE 'z' END AS axis FROM b),
 k AS (SELECT cell, n, axis, CAST(-3 - cell % 5 AS DOUBLE) AS lo, CAST(1 + cell % 3 AS DOUBLE) AS hi, CASE axis WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END AS p FROM {cloud} c JOIN a ON a.cell = c.node),
 q AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY p) AS rank FROM k)
 SELECT cell, n, axis, round(least(greatest(p, (lo+hi)/2 - (hi-lo)*0.1/2), (lo+hi)/2 + (hi-lo)*0.1/2), 5)+0.0 AS middle FROM q WHERE rank = floor(n * 2.0 / 3) + 1""")
def split_planes_in_cells(at: At) -> DataFrame:
    """Planes clamped into the middle of the cell's own box, which is wider than what it holds."""
    points = at["cloud"].withColumnRenamed("node", "cell")
    lo, hi = (F.lit(-3) - F.col("cell") % 5).cast("double"), (F.lit(1) + F.col("cell") % 3).cast("double")
    cells = points.select("cell").distinct().select("cell", *(c.alias(f"cell_{s}_{a}") for a in "xyz" for s, c in (("lo", lo), ("hi", hi))))
    return rounded(partition.split_planes(points, adaptive=0.1, cells=cells))


@query("triangle_sides", "SELECT tri, CASE WHEN 2 * (CAST(x0 >= 50 AS INT) + CAST(x1 >= 50 AS INT) + CAST(x2 >= 50 AS INT)) >= 3 THEN 1 ELSE 0 END AS side FROM {terrain_s}")
def triangle_sides(at: At) -> DataFrame:
    return at["terrain_s"].select("tri", partition.triangle_side("x", F.lit(50.0)).alias("side"))


@query("points_in_cells", "SELECT vid AS pid, n_nationkey AS cell FROM {terrain_v} JOIN {nation} ON x >= n_nationkey * 4 AND x < n_nationkey * 4 + 6 AND y >= n_regionkey AND y < n_regionkey + 10 AND z >= 0 AND z < 30")
def points_in_cells(at: At) -> DataFrame:
    n, g = F.col("n_nationkey"), F.col("n_regionkey")
    cells = at["nation"].select(n.alias("cell"), (n * 4.0).alias("lo_x"), (n * 4.0 + 6).alias("hi_x"), g.cast("double").alias("lo_y"), (g + 10.0).alias("hi_y"), F.lit(0.0).alias("lo_z"), F.lit(30.0).alias("hi_z"))
    return partition.points_in_cells(at["terrain_v"].select(F.col("vid").alias("pid"), "x", "y", "z"), cells, 8.0)


@query("kd_partition")
def kd_partition(at: At) -> DataFrame:
    """Cells and their boxes; tests hold the cap, the cover and the disjointness."""
    cells = partition.kd_partition(at["terrain_v"].select("vid", "x", "y", "z"), 200)
    return cells.groupBy("cell").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


@query("kd_cells", "SELECT vid, TRUE AS under_cap, TRUE AS in_one_box FROM {terrain_v}")
def kd_cells(at: At) -> DataFrame:
    """Every point's cell holds at most the cap, and no other cell's contents lie around it."""
    cells = partition.kd_partition(at["terrain_v"].select("vid", "x", "y", "z"), 200)
    boxes = cells.groupBy("cell").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    around = partition.points_in_cells(cells.select(F.col("vid").alias("pid"), "x", "y", "z"), boxes.select(F.col("cell").alias("cell"), *(f"{s}_{c}" for c in "xyz" for s in ("lo", "hi"))), 8.0)
    others = around.join(cells.select(F.col("vid").alias("pid"), F.col("cell").alias("own")), "pid").groupBy("pid").agg(F.count_if(F.col("cell") != F.col("own")).alias("others"))
    held = cells.join(boxes.select("cell", (F.col("n") <= 200).alias("under_cap")), "cell").join(others.withColumnRenamed("pid", "vid"), "vid", "left")
    return held.select("vid", "under_cap", (F.coalesce("others", F.lit(0)) == 0).alias("in_one_box"))


@query("quantise_coordinates", """WITH q AS (SELECT pid, node, floor(x / 0.015625 + 0.5) AS a, floor(y / 0.015625 + 0.5) AS b, floor(z / 0.015625 + 0.5) AS c FROM {cloud}),
 w AS (SELECT *, min(a) OVER p AS la, max(a) OVER p AS ha, min(b) OVER p AS lb, max(b) OVER p AS hb, min(c) OVER p AS lc, max(c) OVER p AS hc FROM q WINDOW p AS (PARTITION BY node))
 SELECT pid, CAST(a - la AS BIGINT) AS qx, CAST(b - lb AS BIGINT) AS qy, CAST(c - lc AS BIGINT) AS qz, CAST(floor(log2(greatest(ha-la, hb-lb, hc-lc))) AS INT) + 1 AS bits FROM w""")
def quantise_coordinates(at: At) -> DataFrame:
    return codec.quantise(at["cloud"], -6).select("pid", "qx", "qy", "qz", "bits")


@query("dequantised_points", "SELECT pid, " + ", ".join(f"round(floor({c} / 0.015625 + 0.5) * 0.015625, 6) + 0.0 AS {c}" for c in "xyz") + " FROM {cloud}")
def dequantised_points(at: At) -> DataFrame:
    back = codec.dequantise(codec.quantise(at["cloud"], -6), -6)
    return back.select("pid", *(r(F.col(f"d{c}"), 6).alias(c) for c in "xyz"))


@query("dequantised_error", "SELECT node, count(*) AS n, round(max(greatest(" + ", ".join(f"abs({c} - floor({c} / 0.015625 + 0.5) * 0.015625)" for c in "xyz") + ")), 6) AS far FROM {cloud} GROUP BY node")
def dequantised_error(at: At) -> DataFrame:
    back = codec.dequantise(codec.quantise(at["cloud"], -6), -6)
    far = F.greatest(*(F.abs(F.col(c) - F.col(f"d{c}")) for c in "xyz"))
    return back.groupBy("node").agg(F.count("*").alias("n"), F.round(F.max(far), 6).alias("far"))


MORTON = "(" + " | ".join(f"((qx >> {k} & 1) << {3 * k}) | ((qy >> {k} & 1) << {3 * k + 1}) | ((qz >> {k} & 1) << {3 * k + 2})" for k in range(11)) + ")"
CODES = """WITH q AS (SELECT pid, node, CAST(floor(x / 0.015625 + 0.5) AS BIGINT) AS a, CAST(floor(y / 0.015625 + 0.5) AS BIGINT) AS b, CAST(floor(z / 0.015625 + 0.5) AS BIGINT) AS c FROM {cloud}),
 w AS (SELECT pid, node, a - min(a) OVER p AS qx, b - min(b) OVER p AS qy, c - min(c) OVER p AS qz FROM q WINDOW p AS (PARTITION BY node)),
 m AS (SELECT pid, node, """ + MORTON + """ AS code FROM w), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, code ORDER BY pid) AS k FROM m) WHERE k = 1)"""


@query("morton_codes", CODES + " SELECT pid, node, code FROM u")
def morton_codes(at: At) -> DataFrame:
    return codec.ordered_codes(codec.quantise(at["cloud"], -6)).select("pid", "node", "code")


@query("differing_bits", CODES + ", d AS (SELECT pid, node, code, xor(code, lag(code) OVER (PARTITION BY node ORDER BY code)) AS v FROM u) SELECT pid, CAST(floor(log2(v)) AS INT) AS diff FROM d")
def differing_bits(at: At) -> DataFrame:
    return codec.differing_bits(codec.ordered_codes(codec.quantise(at["cloud"], -6))).select("pid", "diff")


@query("morton_round_trip", "SELECT vid, vid AS x, vid * 31 % 2097152 AS y, vid * 7919 % 2097152 AS z FROM {terrain_v}")
def morton_round_trip(at: At) -> DataFrame:
    v = F.col("vid")
    coded = at["terrain_v"].select("vid", bits.morton_words(v, v * 31 % 2097152, v * 7919 % 2097152).alias("code"))
    x, y, z = bits.unmorton_words(F.col("code"))
    return coded.select("vid", x.alias("x"), y.alias("y"), z.alias("z"))


@query("zigzag", "SELECT o_orderkey, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS mapped, d AS back, CASE WHEN d = 0 THEN 0 WHEN d < -1 THEN CAST(floor(log2(-d - 1)) AS INT) + 2 WHEN d = -1 THEN 1 ELSE CAST(floor(log2(d)) AS INT) + 2 END AS needed FROM (SELECT o_orderkey, o_custkey - 70 AS d FROM {orders})")
def zigzag(at: At) -> DataFrame:
    d = F.col("o_custkey") - 70
    return at["orders"].select("o_orderkey", bits.zigzag(d).alias("mapped"), bits.unzigzag(bits.zigzag(d)).alias("back"), bits.bits_needed(d).cast("int").alias("needed"))


@query("normal_differences", "SELECT pid, CAST(q - coalesce(lag(q) OVER (PARTITION BY node ORDER BY pid), 0) AS INT) AS d FROM (SELECT pid, node, CAST(round(nx * 1024) AS INT) AS q FROM {cloud})")
def normal_differences(at: At) -> DataFrame:
    q = at["cloud"].select("pid", "node", F.round(F.col("nx") * 1024).cast("int").alias("q"))
    return q.select("pid", (F.col("q") - F.coalesce(F.lag("q").over(Window.partitionBy("node").orderBy("pid")), F.lit(0))).alias("d"))


@query("colour_transform", "SELECT vid, g AS y, CAST((b - g + 256) % 256 AS INT) AS cb, CAST((r - g + 256) % 256 AS INT) AS cr, r AS back_r, b AS back_b FROM {terrain_v}")
def colour_transform(at: At) -> DataFrame:
    y, cb, cr = colours.to_differences(F.col("r"), F.col("g"), F.col("b"))
    coded = at["terrain_v"].select("vid", y.alias("y"), cb.alias("cb"), cr.alias("cr"))
    rr, _, bb = colours.from_differences(F.col("y"), F.col("cb"), F.col("cr"))
    return coded.select("*", rr.alias("back_r"), bb.alias("back_b"))


@query("compact_degenerate", "SELECT src, patch, CAST(sum(sum(CAST(i0 <> i1 AND i1 <> i2 AND i0 <> i2 AS INT))) OVER (PARTITION BY src ORDER BY patch) AS BIGINT) AS tri_end FROM (SELECT l_suppkey AS src, l_linenumber AS patch, l_orderkey % 3 AS i0, l_partkey % 3 AS i1, CAST(l_quantity AS BIGINT) % 3 AS i2 FROM {lineitem}) GROUP BY src, patch")
def compact_degenerate(at: At) -> DataFrame:
    faces = at["lineitem"].select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("patch"), (F.col("l_orderkey") % 3).alias("i0"), (F.col("l_partkey") % 3).alias("i1"), (F.col("l_quantity").cast("long") % 3).alias("i2"))
    return codec.compact_degenerate(faces)


@query("symbol_entropy", "WITH c AS (SELECT node, pid % 7 * (pid % 3) AS s, count(*) AS k FROM {cloud} GROUP BY ALL), t AS (SELECT node, sum(k) AS n FROM c GROUP BY node) SELECT node, round(-sum(k / n * log2(k / n)), 5) AS entropy FROM c JOIN t USING (node) GROUP BY node")
def symbol_entropy(at: At) -> DataFrame:
    return rounded(codec.entropy(at["cloud"].select("node", (F.col("pid") % 7 * (F.col("pid") % 3)).alias("s")), "node", "s"))


@query("octahedral", """WITH q AS (SELECT pid, nx/(abs(nx)+abs(ny)+abs(nz)) AS u, ny/(abs(nx)+abs(ny)+abs(nz)) AS v, nz FROM {cloud})
 SELECT pid, CAST(round(CASE WHEN nz < 0 THEN (1-abs(v)) * CASE WHEN u >= 0 THEN 1 ELSE -1 END ELSE u END * 511) AS INT) AS u, CAST(round(CASE WHEN nz < 0 THEN (1-abs(u)) * CASE WHEN v >= 0 THEN 1 ELSE -1 END ELSE v END * 511) AS INT) AS v FROM q""")
def octahedral(at: At) -> DataFrame:
    u, v = codec.octahedral(F.col("nx"), F.col("ny"), F.col("nz"), 511)
    return at["cloud"].select("pid", u.alias("u"), v.alias("v"))


@query("padding", "SELECT o_orderkey AS n, CAST(ceil(o_orderkey / 256.0) * 256 AS BIGINT) AS padded, CAST(ceil(o_orderkey / 64.0) * 64 AS BIGINT) AS chunk, CAST(pow(2, ceil(log2(o_orderkey))) AS BIGINT) AS power FROM {orders} WHERE o_orderkey > 0")
def padding(at: At) -> DataFrame:
    n = F.col("o_orderkey")
    return at["orders"].filter("o_orderkey > 0").select(n.alias("n"), bits.pad(n).alias("padded"), bits.pad(n, 64).alias("chunk"), bits.next_power_of_two(n).alias("power"))


@query("colormap_lookup", """WITH t AS (SELECT vid, least(greatest(z / 50, 0), 1) * 8 AS f FROM {terrain_v}), k AS (SELECT vid, f, CAST(least(floor(f), 7) AS BIGINT) AS k FROM t),
 s AS (SELECT [68,71,59,44,33,39,92,170,253] AS rs, [1,44,81,113,144,173,200,220,231] AS gs, [84,122,139,142,141,129,99,50,37] AS bs)
 SELECT vid, CAST(floor(rs[k+1]*(1-(f-k)) + rs[k+2]*(f-k)) AS INT) AS r, CAST(floor(gs[k+1]*(1-(f-k)) + gs[k+2]*(f-k)) AS INT) AS g, CAST(floor(bs[k+1]*(1-(f-k)) + bs[k+2]*(f-k)) AS INT) AS b FROM k, s""")
def colormap_lookup(at: At) -> DataFrame:
    c = colours.colormap(F.col("z"), 0.0, 50.0)
    return at["terrain_v"].select("vid", c.alias("c")).select("vid", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate("rgb")))


@query("debug_colours", "SELECT vid, (vid % 11 * 171) % 63 + 63 AS r, (vid % 16 * 135) % 63 + 63 AS g, (vid % 7 * 51) % 63 + 63 AS b FROM {terrain_v}")
def debug_colours(at: At) -> DataFrame:
    return at["terrain_v"].select("vid", *(c.alias(n) for c, n in zip(colours.debug_colour(F.col("vid")), "rgb")))


@query("matrix_transform", "SELECT vid, round(2*x + 1, 7) AS x, round(-z + 2, 7) AS y, round(y + 3, 7) AS z FROM {terrain_v}")
def matrix_transform(at: At) -> DataFrame:
    p = transform([2, 0, 0, 1, 0, 0, -1, 2, 0, 1, 0, 3, 0, 0, 0, 1], vec("x", "y", "z"))
    return rounded(at["terrain_v"].select("vid", p.x.alias("x"), p.y.alias("y"), p.z.alias("z")), 7)


@query("triangle_areas", "SELECT tri, round(sqrt(pow((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0),2)+pow((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0),2)+pow((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0),2))/2,4) AS area FROM {terrain_s}")
def triangle_areas(at: At) -> DataFrame:
    return rounded(at["terrain_s"].select("tri", mesh.triangle_area(corner(0), corner(1), corner(2)).alias("area")), 4)


@query("unified_vertices", """WITH c AS (SELECT s.node, unnest([f.i0,f.i1,f.i2]) AS vid, f.tri * 3 + unnest([0,1,2]) AS pos FROM {terrain_f} f JOIN {terrain_s} s USING (tri)), m AS (SELECT node, vid, min(pos) AS first FROM c GROUP BY node, vid)
 SELECT node, vid, row_number() OVER (ORDER BY node, first) - 1 AS id FROM m""")
def unified_vertices(at: At) -> DataFrame:
    """Vertices that drawn triangles use, numbered in the order of first use."""
    node = F.floor(F.col("tri") / 500.0).alias("node")
    used = mesh.face_corners(at["terrain_f"]).select(node, "vid", (F.col("tri") * 3 + F.col("corner")).alias("pos"))
    first = used.groupBy("node", "vid").agg(F.min("pos").alias("first"))
    return dense_number(first, F.col("node"), F.col("first"), name="id").select("node", "vid", "id")


@query("scene_layout", "SELECT n_nationkey AS instance, n_nationkey % 3 AS model, n_nationkey - floor(n_nationkey / 5) * 5 AS x, floor(n_nationkey / 5) AS y FROM {nation}")
def scene_layout(at: At) -> DataFrame:
    i = F.col("n_nationkey")
    return at["nation"].select(i.alias("instance"), (i % 3).alias("model"), (i - F.floor(i / 5) * 5).cast("double").alias("x"), F.floor(i / 5).cast("double").alias("y"))


@query("georeference", """SELECT vid // 1000 AS tile, '{"origin":[' || min(x) || ',' || min(y) || ']}' AS sidecar, min(x) AS origin_x, min(y) AS origin_y FROM {terrain_v} GROUP BY vid // 1000""")
def georeference(at: At) -> DataFrame:
    from lodestone.sources.text_meshes import georeference_of, georeference_json

    tile = F.floor(F.col("vid") / 1000).alias("tile")
    made = at["terrain_v"].groupBy(tile).agg(georeference_json(F.min("x"), F.min("y")).alias("sidecar"))
    origin = georeference_of(F.col("sidecar"))
    return made.select("tile", "sidecar", F.get(origin, F.lit(0)).alias("origin_x"), F.get(origin, F.lit(1)).alias("origin_y"))


@query("texture_tiles", "SELECT o_orderkey AS tex, tx, ty, least(4096, w - tx * 4096) AS tile_w, least(4096, h - ty * 4096) AS tile_h FROM (SELECT o_orderkey, w, h, unnest(range(0, (w + 4095) // 4096)) AS tx FROM (SELECT o_orderkey, 1000 + o_orderkey * 37 % 9000 AS w, 500 + o_orderkey * 91 % 9000 AS h FROM {orders})) a, LATERAL (SELECT unnest(range(0, (h + 4095) // 4096)) AS ty) b")
def texture_tiles(at: At) -> DataFrame:
    from lodestone.operators.textures import tiles

    k = F.col("o_orderkey")
    return tiles(at["orders"].select(k.alias("tex"), (1000 + k * 37 % 9000).alias("w"), (500 + k * 91 % 9000).alias("h"))).select("tex", "tx", "ty", "tile_w", "tile_h")


@query("texel_error", "SELECT node, round(avg(CASE WHEN least(p, 10) < 1 THEN d ELSE d / least(p, 10) END), 5) AS error FROM (SELECT node, sqrt(d2) AS d, sqrt(d2) * 3 AS p FROM (SELECT node, " + EDGE2 + " AS d2 FROM {terrain_s})) GROUP BY node")
def texel_error(at: At) -> DataFrame:
    from lodestone.operators.textures import texel_error as error

    a, b, c = corner(0), corner(1), corner(2)
    edges = at["terrain_s"].select("node", F.explode(F.array((b - a).norm(), (c - b).norm(), (a - c).norm())).alias("edge"))
    return rounded(error(edges.withColumn("pixels", F.col("edge") * 3)))


@query("cloud_payloads", CODES + " SELECT node, CAST(qx AS BIGINT) AS qx, CAST(qy AS BIGINT) AS qy, CAST(qz AS BIGINT) AS qz FROM (SELECT DISTINCT node, qx, qy, qz FROM w)")
def cloud_payloads(at: At) -> DataFrame:
    """Compressed and decompressed again: each distinct quantised point of a node."""
    return payload.decompress_clouds(payload.compress_clouds(codec.quantise(at["cloud"], -6)))
