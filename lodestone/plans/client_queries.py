"""Queries on a streaming client's cut, saturated spheres, cones, colours, clouds and monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import colours, vectors, views
from lodestone.functions.vectors import Vec, vec
from lodestone.operators import cache, codec, dag, mesh, partition
from lodestone.plans.dag_queries import LEAVES, SINK
from lodestone.plans.registry import At, query, r, rounded

STATE = "SELECT *, node % 7 <> 3 AS ready, node % 5 <> 0 AS visible FROM {dag_nodes}"


@query("client_cut", """WITH RECURSIVE n AS (""" + STATE + """), o AS (SELECT *, NOT ready OR error < 2.2 AND node IN (SELECT dst FROM {dag_patches}) AS own FROM n),
 b AS (SELECT node FROM o WHERE own UNION SELECT p.dst FROM {dag_patches} p JOIN b ON b.node = p.src),
 d AS (SELECT *, node IN (SELECT node FROM b) AS below, CASE WHEN visible AND node NOT IN (SELECT node FROM b) THEN nvert * 0.8 ELSE 0 END AS drawn FROM o),
 s AS (SELECT *, below OR sum(drawn) OVER (ORDER BY error DESC, node ROWS UNBOUNDED PRECEDING) - drawn > 3000 AS blocked FROM d),
 v AS (SELECT * FROM (SELECT *, sum(blocked::INT) OVER (ORDER BY error DESC, node ROWS UNBOUNDED PRECEDING) - blocked::INT AS so_far FROM s) WHERE so_far < 30)
 SELECT node, NOT blocked AS selected, node IN (SELECT node FROM v WHERE NOT ready ORDER BY error DESC, node LIMIT 3) AS requested FROM v""")
def client_cut(at: At) -> DataFrame:
    nodes = at["dag_nodes"].withColumns({"ready": F.col("node") % 7 != 3, "visible": F.col("node") % 5 != 0})
    return dag.client_cut(nodes, at["dag_patches"], 2.2, 3000.0)


def _reach(child: str) -> str:
    return f"SELECT p.src AS node, max(sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2)+pow(a.cz-b.cz,2)) + b.radius) AS reach FROM {{dag_patches}} p JOIN {{dag_nodes}} a ON a.node = p.src JOIN ({child}) b ON b.node = p.dst GROUP BY p.src"


def _raised(lvl: int, child: str) -> str:
    return f"SELECT n.node, cx, cy, cz, CASE WHEN reach IS NULL THEN radius ELSE greatest(radius, reach) * 1.01 END AS radius FROM {{dag_nodes}} n LEFT JOIN ({_reach(child)}) r ON r.node = n.node WHERE lvl = {lvl}"


SPHERES = (
    "WITH s3 AS (SELECT node, cx, cy, cz, radius FROM {dag_nodes} WHERE lvl = 3), s2 AS (" + _raised(2, "SELECT * FROM s3") + "), t2 AS (SELECT * FROM s3 UNION ALL SELECT * FROM s2), s1 AS (" + _raised(1, "SELECT * FROM t2")
    + "), t1 AS (SELECT * FROM t2 UNION ALL SELECT * FROM s1), s0 AS (" + _raised(0, "SELECT * FROM t1") + "), s AS (SELECT * FROM t1 UNION ALL SELECT * FROM s0)"
)


@query("saturate_spheres", SPHERES + " SELECT node, round(radius, 4) AS radius FROM s")
def saturate_spheres(at: At) -> DataFrame:
    return rounded(dag.saturate_spheres(at["dag_nodes"], at["dag_patches"]).select("node", "radius"), 4)


@query("sphere_violations", "SELECT DISTINCT p.src, p.dst FROM {dag_patches} p JOIN {dag_nodes} a ON a.node = p.src JOIN {dag_nodes} b ON b.node = p.dst WHERE sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2)+pow(a.cz-b.cz,2)) + b.radius > a.radius")
def sphere_violations(at: At) -> DataFrame:
    return dag.sphere_violations(at["dag_nodes"], at["dag_patches"])


@query("root_errors", "SELECT node, round(CASE WHEN node IN (SELECT dst FROM {dag_patches}) THEN error ELSE radius END, 5) AS error FROM {dag_nodes}")
def root_errors(at: At) -> DataFrame:
    return rounded(dag.with_root_errors(at["dag_nodes"], at["dag_patches"]).select("node", "error"))


@query("patch_dump", "SELECT patch, src AS node, tri_begin AS offset, tri_end - tri_begin AS triangles FROM {dag_patches}")
def patch_dump(at: At) -> DataFrame:
    return dag.patch_dump(at["dag_patches"])


@query("last_level_bytes", "SELECT count(*) AS nodes, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM {dag_nodes} WHERE node IN (SELECT src FROM (SELECT src, arg_min(dst, patch) AS dst FROM {dag_patches} GROUP BY src) WHERE dst = " + SINK + ")")
def last_level_bytes(at: At) -> DataFrame:
    return dag.last_level_bytes(at["dag_nodes"], at["dag_patches"])


CONE = "SELECT node, cx - (3 + node % 4) AS dx, cy - 2 AS dy, cz - (-40 + node % 90) AS dz, 0.6 * 1.3 AS ax, 0.0 AS ay, 0.8 * 1.3 AS az FROM {dag_nodes}"


@query("anchored_cones", "SELECT node, f >= 0.001 AND f * f >= d AS back, -f >= 0.001 AND f * f >= d AS front FROM (SELECT node, dx*ax + dy*ay + dz*az AS f, dx*dx + dy*dy + dz*dz AS d FROM (" + CONE + "))")
def anchored_cones(at: At) -> DataFrame:
    k = F.col("node")
    axis, eye, anchor = Vec(F.lit(0.6 * 1.3), F.lit(0.0), F.lit(0.8 * 1.3)), Vec((3 + k % 4).cast("double"), F.lit(2.0), (-40 + k % 90).cast("double")), vec("cx", "cy", "cz")
    return at["dag_nodes"].select("node", views.anchored_backface(axis, anchor, eye).alias("back"), views.anchored_frontface(axis, anchor, eye).alias("front"))


@query("quantised_cone_faces", """WITH q AS (SELECT node, 0.6 AS ax, 0.8 AS az, 4000 + node % 9 * 4000 AS len, cx, cy, cz, radius, -60 + node % 120 AS ez FROM {dag_nodes}),
 p AS (SELECT node, len, cx - ax*radius - 3 AS bx, cy - 2 AS gy, cz - az*radius - ez AS bz, cx + ax*radius - 3 AS fx, cz + az*radius - ez AS fz, ax, az FROM (SELECT node, len, round(ax*32766)/32766 AS ax, round(az*32766)/32766 AS az, cx, cy, cz, radius, ez FROM q)),
 t AS (SELECT node, (bx*ax + bz*az) * len / 3276 AS b, bx*bx + gy*gy + bz*bz AS bb, -(fx*ax + fz*az) * len / 3276 AS f, fx*fx + gy*gy + fz*fz AS ff FROM p)
 SELECT node, b >= 0.001 AND b*b >= bb AS back, f >= 0.001 AND f*f >= ff AS front FROM t""")
def quantised_cone_faces(at: At) -> DataFrame:
    k = F.col("node")
    n = Vec(*(views.quantise_axis(F.lit(x)).cast("double") for x in (0.6, 0.0, 0.8)))
    back, front = views.quantised_cone_faces(n, (4000 + k % 9 * 4000).cast("double"), Vec(F.lit(3.0), F.lit(2.0), (-60 + k % 120).cast("double")), vec("cx", "cy", "cz"), F.col("radius"), strict=True)
    return at["dag_nodes"].select("node", back.alias("back"), front.alias("front"))


def _map_sql(name: str) -> str:
    stops = colours.MAPS[name]
    n = len(stops) - 1
    lists = ", ".join(f"[{', '.join(repr(255 * s[i]) for s in stops)}]::DOUBLE[] AS c{i}" for i in range(3))
    picks = ", ".join(f"CAST(floor(c{i}[k+1]*(1-(f-k)) + c{i}[k+2]*(f-k)) AS INT) AS {c}" for i, c in enumerate("rgb"))
    return f"SELECT '{name}' AS name, vid, {picks} FROM (SELECT vid, f, CAST(least(floor(f), {n - 1}) AS BIGINT) AS k FROM (SELECT vid, least(greatest((z - 5) / (30.0 - 5), 0), 1) * {n} AS f FROM {{terrain_v}})), (SELECT {lists}) s"


@query("colormaps", " UNION ALL ".join(map(_map_sql, colours.MAPS)))
def colormaps(at: At) -> DataFrame:
    each = F.array(*(F.struct(F.lit(name).alias("name"), colours.mapped(F.col("z"), 5.0, 30.0, name).alias("c")) for name in colours.MAPS))
    return at["terrain_v"].select("vid", F.explode(each).alias("m")).select("m.name", "vid", *(F.get("m.c", F.lit(i)).alias(c) for i, c in enumerate("rgb")))


@query("texel_weights", "SELECT tri, round(abs((x1-x0)*(y2-y0) - (x2-x0)*(y1-y0)) / 2 * (256 << (tri % 4)::INT) * 512 * 0.05, 4) + 0.0 AS weight FROM {soup}")
def texel_weights(at: At) -> DataFrame:
    u, v = (tuple(F.col(f"{c}{i}") for i in range(3)) for c in "xy")
    wide = F.lit(256) * F.pow(F.lit(2.0), F.col("tri") % 4)
    return rounded(at["soup"].select("tri", mesh.texel_weight(u, v, wide, F.lit(512), 0.05).alias("weight")), 4)


@query("block_occupancy", "SELECT node, count(*) AS used, round(count(*) / 300.0, 5) AS fullness, count(*) >= 300 AS \"full\" FROM {terrain_s} GROUP BY node")
def block_occupancy(at: At) -> DataFrame:
    return rounded(partition.occupancy(at["terrain_s"], 300))


@query("cloud_vertices", "SELECT node, row_number() OVER (PARTITION BY node ORDER BY pid) - 1 AS vid, x, y, z FROM {cloud}")
def cloud_vertices(at: At) -> DataFrame:
    return mesh.cloud_vertices(at["cloud"])


@query("cloud_level", "SELECT node, pid, floor(ceil(i / s) * s) = i AS stays FROM (SELECT pid, node, row_number() OVER (PARTITION BY node ORDER BY pid) - 1 AS i, greatest(CAST(count(*) OVER (PARTITION BY node) AS DOUBLE) / 25, 1) AS s FROM {cloud})")
def cloud_level(at: At) -> DataFrame:
    stays, goes = mesh.cloud_level(at["cloud"].select("node", "pid"), F.lit(25.0))
    return stays.withColumn("stays", F.lit(True)).unionByName(goes.withColumn("stays", F.lit(False))).select("node", "pid", "stays")


@query("tight_radii", "WITH n AS (SELECT node, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM {cloud} GROUP BY node) SELECT n.node, round(greatest(0.5 + n.node % 3, max(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)))), 5) AS radius FROM n JOIN {cloud} c ON c.node = n.node GROUP BY n.node")
def tight_radii(at: At) -> DataFrame:
    centres = at["cloud"].groupBy("node").agg(*(F.avg(c).alias(f"c{c}") for c in "xyz")).withColumn("radius", 0.5 + F.col("node") % 3)
    return rounded(mesh.tight_radii(centres, at["cloud"]).select("node", "radius"))


@query("quantised_uv", """WITH q AS (SELECT pid, node, floor(x / 0.03125 + 0.5) AS a, floor(y / 0.03125 + 0.5) AS b FROM {cloud}), w AS (SELECT *, min(a) OVER p AS la, max(a) OVER p AS ha, min(b) OVER p AS lb, max(b) OVER p AS hb FROM q WINDOW p AS (PARTITION BY node))
 SELECT pid, CAST(a - la AS BIGINT) AS qu, CAST(b - lb AS BIGINT) AS qv, CAST(floor(log2(greatest(ha-la, hb-lb))) AS INT) + 1 AS bits FROM w""")
def quantised_uv(at: At) -> DataFrame:
    return codec.quantise_uv(at["cloud"].select("pid", "node", F.col("x").alias("u"), F.col("y").alias("v")), -5).select("pid", "qu", "qv", "bits")


@query("coordinate_steps", "SELECT node, round(radius / 4096, 9) AS step, CAST(trunc(log2(radius / 4096)) AS INT) AS exponent FROM {dag_nodes} JOIN " + LEAVES + " l USING (node)")
def coordinate_steps(at: At) -> DataFrame:
    leaf = at["dag_patches"].filter(F.col("dst") == dag.sink_of(at["dag_patches"])).select(F.col("src").alias("node")).distinct()
    step = codec.step_for_bits(F.col("radius"), 12)
    return rounded(at["dag_nodes"].join(leaf, "node").select("node", step.alias("step"), codec.step_exponent(step).alias("exponent")), 9)


@query("renderer_rate", """WITH RECURSIVE o AS (SELECT camera, frame, elapsed_ms, row_number() OVER (PARTITION BY camera ORDER BY frame) AS k FROM {frames}),
 s AS (SELECT camera, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS frame, CAST(0 AS DOUBLE) AS fps FROM (SELECT DISTINCT camera FROM o)
  UNION ALL SELECT o.camera, o.k, o.frame, CASE WHEN elapsed_ms > 0 THEN (1 - CAST(0.9 AS DOUBLE)) * (1000 / elapsed_ms) + 0.9 * s.fps ELSE s.fps END FROM o JOIN s ON o.camera = s.camera AND o.k = s.k + 1)
 SELECT camera, frame, round(fps, 4) AS fps FROM s WHERE k > 0""")
def renderer_rate(at: At) -> DataFrame:
    return rounded(cache.renderer_rate(at["frames"].select("camera", "frame", "elapsed_ms")), 4)


@query("monitor_shares", "SELECT frame, CAST(floor((frame * 37 % 2000) * 100 / 1500) AS INT) AS cache, round(least(5, log2((2 + error) / 2)) * 100 / 5, 4) + 0.0 AS wrong, round(least(3, greatest(0, 60 / (1000 / elapsed_ms) - 1)) * 100 / 3, 4) + 0.0 AS slow FROM {frames} WHERE error >= 0")
def monitor_shares(at: At) -> DataFrame:
    shares = cache.monitor_shares((F.col("frame") * 37 % 2000).cast("double"), F.lit(1500.0), 2 + F.col("error"), F.lit(2.0), 1000 / F.col("elapsed_ms"))
    return rounded(at["frames"].filter("error >= 0").select("frame", *(c.alias(n) for n, c in zip(("cache", "wrong", "slow"), shares))), 4)


@query("shared_requests", "SELECT camera % 3 AS mesh, frame // 50 AS frame, node, max(error) AS error, count(DISTINCT camera) AS asked FROM {frames} GROUP BY ALL")
def shared_requests(at: At) -> DataFrame:
    asked = at["frames"].select(F.col("camera").alias("instance"), F.floor(F.col("frame") / 50).alias("frame"), "node", "error")
    instances = at["frames"].select(F.col("camera").alias("instance"), (F.col("camera") % 3).alias("mesh")).distinct()
    return cache.shared_requests(asked, instances)


@query("model_matrices", "SELECT n_nationkey AS instance, unnest(range(0, 16)) AS entry, unnest([k, 0, 0, -k*t, 0, k, 0, -2.0*k, 0, 0, k, 0.5*k, 0, 0, 0, 1]::DOUBLE[]) AS value, unnest([1/k, 0, 0, t, 0, 1/k, 0, 2.0, 0, 0, 1/k, -0.5, 0, 0, 0, 1]::DOUBLE[]) AS inverse FROM (SELECT n_nationkey, CAST(1 << (n_nationkey % 5)::INT AS DOUBLE) AS k, CAST(n_regionkey AS DOUBLE) AS t FROM {nation})")
def model_matrices(at: At) -> DataFrame:
    """Scale times translation, and its inverse."""
    d = lambda *row: F.array(*(x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in row))
    k, t = F.pow(F.lit(2.0), F.col("n_nationkey") % 5), F.col("n_regionkey").cast("double")
    scale, moved = d(k, 0, 0, 0, 0, k, 0, 0, 0, 0, k, 0, 0, 0, 0, 1), d(1, 0, 0, -t, 0, 1, 0, -2, 0, 0, 1, 0.5, 0, 0, 0, 1)
    both = at["nation"].select(F.col("n_nationkey").alias("instance"), vectors.matrix_product(scale, moved).alias("m")).withColumn("i", vectors.matrix_inverse(F.col("m")))
    each = both.select("instance", F.posexplode(F.arrays_zip("m", "i")).alias("entry", "x"))
    return each.select("instance", F.col("entry").cast("long").alias("entry"), (F.col("x.m") + 0.0).alias("value"), (F.col("x.i") + 0.0).alias("inverse"))


@query("scene_normalised", """WITH i AS (SELECT n_nationkey AS instance, n_regionkey AS model, 5 AS side FROM {nation}), s AS (SELECT node AS model, cx, cy, cz, radius FROM {dag_nodes})
 SELECT instance, round((instance - floor(instance / side) * side) - cx / (2 * radius), 5) + 0.0 AS tx, round(-cy / (2 * radius), 5) + 0.0 AS ty, round(floor(instance / side) - cz / (2 * radius), 5) + 0.0 AS tz, round(1 / (2 * radius), 5) AS scale FROM i JOIN s USING (model)""")
def scene_normalised(at: At) -> DataFrame:
    from lodestone.operators.scan import dense_number

    n = at["nation"].count()
    instances = dense_number(at["nation"].select(F.col("n_nationkey"), F.col("n_regionkey").alias("model")), F.col("n_nationkey"), name="instance")
    spheres = at["dag_nodes"].select(F.col("node").alias("model"), "cx", "cy", "cz", "radius")
    return rounded(mesh.scene_layout(instances.join(spheres, "model"), int(n**0.5)).select("instance", "tx", "ty", "tz", "scale"))


@query("screen_pixels", "SELECT view, node, round(resolution * sqrt((cx-ex)*(cx-ex)+(cy-ey)*(cy-ey)+(cz-ez)*(cz-ez)), 6) AS pixel FROM {dag_nodes}, {eyes}")
def screen_pixels(at: At) -> DataFrame:
    from lodestone.plans.dag_queries import seen

    return seen(at).select("view", "node", r(views.pixel_size(F.col("resolution"), (vec("cx", "cy", "cz") - vec("ex", "ey", "ez")).norm()), 6).alias("pixel"))


@query("outside_penalty", "SELECT node, round(CASE WHEN d < 0 THEN error * 0.001 / (1 + d * d) ELSE error END, 7) AS error FROM (SELECT node, error, cx - 25.5 + radius AS d FROM {dag_nodes})")
def outside_penalty(at: At) -> DataFrame:
    return rounded(at["dag_nodes"].select("node", views.outside_penalty(F.col("error"), F.col("cx") - 25.5 + F.col("radius")).alias("error")), 7)


@query("uv_areas", "SELECT tri, round(abs((x1-x0)*(y2-y0) - (x2-x0)*(y1-y0)) / 2, 5) + 0.0 AS area FROM {soup}")
def uv_areas(at: At) -> DataFrame:
    u, v = (tuple(F.col(f"{c}{i}") for i in range(3)) for c in "xy")
    return rounded(at["soup"].select("tri", mesh.uv_area(u, v).alias("area")))


@query("node_plys", """WITH c AS (SELECT tri, node, unnest([0,1,2]) AS corner, unnest([x0,x1,x2]) AS x, unnest([y0,y1,y2]) AS y, unnest([z0,z1,z2]) AS z FROM {terrain_s}),
 v AS (SELECT node, x, y, z, row_number() OVER (PARTITION BY node ORDER BY z, y, x) - 1 AS vid FROM (SELECT DISTINCT node, x, y, z FROM c)),
 f AS (SELECT tri, node, max(vid) FILTER (corner = 0) AS i0, max(vid) FILTER (corner = 1) AS i1, max(vid) FILTER (corner = 2) AS i2 FROM c JOIN v USING (node, x, y, z) GROUP BY tri, node),
 p AS (SELECT node, count(*) AS nvert, string_agg(CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR) || ' ' || CAST(z AS VARCHAR), chr(10) ORDER BY vid) AS points FROM v GROUP BY node),
 r AS (SELECT node, count(*) AS nface, string_agg('3 ' || i0 || ' ' || i1 || ' ' || i2, chr(10) ORDER BY tri) AS rings FROM f GROUP BY node)
 SELECT node, concat_ws(chr(10), 'ply', 'format ascii 1.0', 'element vertex ' || nvert, 'property float x', 'property float y', 'property float z', 'element face ' || nface, 'property list uchar int vertex_indices', 'end_header', points, rings) || chr(10) AS ply FROM p JOIN r USING (node)""")
def node_plys(at: At) -> DataFrame:
    from lodestone.sinks import mesh_files

    verts, faces = mesh.weld(at["terrain_s"])
    return mesh_files.node_plys(verts, faces)


@query("compressed_payloads", "SELECT node, floor(x / 0.0625 + 0.5) * 0.0625 AS x, floor(y / 0.0625 + 0.5) * 0.0625 AS y, floor(z / 0.0625 + 0.5) * 0.0625 AS z, count(*) AS uses FROM (SELECT node, unnest([x0,x1,x2]) AS x, unnest([y0,y1,y2]) AS y, unnest([z0,z1,z2])::FLOAT::DOUBLE AS z FROM {terrain_s}) c GROUP BY ALL")
def compressed_payloads(at: At) -> DataFrame:
    """What readers of compressed node payloads get: each quantised corner with the number of faces that use it."""
    from lodestone.sinks.mesh_files import node_payloads
    from lodestone.sources.model_file import expanded_triangles

    packed = node_payloads(at["terrain_s"].withColumn("id", F.col("node")).withColumn("to", F.col("tri") % 3), -4)
    back = expanded_triangles(packed).withColumnRenamed("id", "node")
    corners = back.select("node", F.explode(F.array(*(F.struct(*(F.col(f"{c}{k}").alias(c) for c in "xyz")) for k in range(3)))).alias("p"))
    return corners.groupBy("node", "p.x", "p.y", "p.z").agg(F.count("*").alias("uses"))
