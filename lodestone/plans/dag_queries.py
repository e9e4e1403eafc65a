"""Queries on level-of-detail DAGs, views, rays, reports and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import views
from lodestone.functions.colours import human_bytes
from lodestone.functions.vectors import vec
from lodestone.operators import cache, dag, rays
from lodestone.operators.scan import small
from lodestone.plans.registry import At, query, r, rounded
from lodestone.session import materialize



def spent(cost: str) -> str:
    return f"(SELECT *, sum({cost}) OVER (ORDER BY error DESC, node ROWS UNBOUNDED PRECEDING) AS spent FROM {{dag_nodes}}) q"


SINK = "(SELECT max(dst) FROM {dag_patches})"
#: The nodes of the first 5000 triangles, as most cut queries select them.
CHOSEN = f"c AS (SELECT * FROM {spent('nface')} WHERE spent <= 5000)"
CUT = CHOSEN + ", k AS (SELECT * FROM {dag_patches} p WHERE src IN (SELECT node FROM c) AND dst NOT IN (SELECT node FROM c))"


def chosen(at: At) -> DataFrame:
    return materialize(dag.select_budget(at["dag_nodes"], "nface", 5000), "chosen")  # a cut reads it more than once


@query("select_by_triangles", f"SELECT node, CAST(spent AS BIGINT) AS spent FROM {spent('nface')} WHERE spent <= 5000")
def select_by_triangles(at: At) -> DataFrame:
    return chosen(at).select("node", F.col("spent").cast("long").alias("spent"))


@query("select_by_size", f"SELECT node, CAST(spent AS BIGINT) AS spent FROM {spent('bytes')} WHERE spent <= 1000000")
def select_by_size(at: At) -> DataFrame:
    return dag.select_budget(at["dag_nodes"], "bytes", 1_000_000).select("node", F.col("spent").cast("long").alias("spent"))


@query("select_by_error", "SELECT node, error FROM {dag_nodes} WHERE error >= 2.5")
def select_by_error(at: At) -> DataFrame:
    return dag.select_error(at["dag_nodes"], 2.5).select("node", "error")


@query("sink_distance", "WITH RECURSIVE f AS (SELECT src, arg_min(dst, patch) AS dst FROM {dag_patches} GROUP BY src), d AS (SELECT " + SINK + " AS node, 0 AS distance UNION ALL SELECT f.src, d.distance + 1 FROM f JOIN d ON f.dst = d.node) SELECT node, distance FROM d")
def sink_distance(at: At) -> DataFrame:
    return dag.sink_distance(at["dag_patches"])


@query("select_by_level", "WITH RECURSIVE f AS (SELECT src, arg_min(dst, patch) AS dst FROM {dag_patches} GROUP BY src), d AS (SELECT " + SINK + " AS node, 0 AS distance UNION ALL SELECT f.src, d.distance + 1 FROM f JOIN d ON f.dst = d.node) SELECT n.node FROM {dag_nodes} n JOIN d USING (node) WHERE (SELECT max(distance) FROM d) - distance <= 1")
def select_by_level(at: At) -> DataFrame:
    return dag.select_level(at["dag_nodes"], at["dag_patches"], 1).select("node")


@query("select_composed", f"SELECT node FROM {spent('nface')} WHERE spent <= 5000 AND error >= 3")
def select_composed(at: At) -> DataFrame:
    return dag.select_error(chosen(at), 3.0).select("node")


@query("drop_last_level", "SELECT node FROM {dag_nodes} WHERE node NOT IN (SELECT src FROM (SELECT src, arg_min(dst, patch) AS dst FROM {dag_patches} GROUP BY src) WHERE dst = " + SINK + ")")
def drop_last_level(at: At) -> DataFrame:
    return dag.drop_last_level(at["dag_nodes"], at["dag_patches"]).select("node")


@query("cut_patches", "WITH " + CUT + " SELECT patch, src, dst, tri_begin, tri_end FROM k")
def cut_patches(at: At) -> DataFrame:
    return dag.cut(chosen(at), at["dag_patches"]).select("patch", "src", "dst", "tri_begin", "tri_end")


@query("skipped_nodes", "WITH " + CUT + " SELECT node FROM c WHERE node NOT IN (SELECT src FROM k)")
def skipped_nodes(at: At) -> DataFrame:
    some = chosen(at)
    return some.join(dag.drawn_nodes(some, at["dag_patches"]).select("node"), "node", "left_anti").select("node")


@query("count_cut", "WITH " + CUT + " SELECT count(*) AS nodes, CAST(sum(nvert) AS BIGINT) AS vertices, (SELECT CAST(sum(tri_end - tri_begin) AS BIGINT) FROM k) AS faces FROM c WHERE node IN (SELECT src FROM k)")
def count_cut(at: At) -> DataFrame:
    return dag.count_cut(chosen(at), at["dag_patches"])


@query("merged_ranges", "WITH " + CUT + ", g AS (SELECT *, CASE WHEN lag(tri_end) OVER w = tri_begin THEN 0 ELSE 1 END AS n FROM k WINDOW w AS (PARTITION BY src ORDER BY tri_begin)), h AS (SELECT *, sum(n) OVER (PARTITION BY src ORDER BY tri_begin ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT src, min(tri_begin) AS tri_begin, max(tri_end) AS tri_end FROM h GROUP BY src, run")
def merged_ranges(at: At) -> DataFrame:
    return dag.merged_ranges(dag.cut(chosen(at), at["dag_patches"]))


@query("roots", "SELECT node FROM {dag_nodes} WHERE node NOT IN (SELECT dst FROM {dag_patches})")
def roots(at: At) -> DataFrame:
    return dag.roots(at["dag_nodes"], at["dag_patches"]).select("node")


SATURATE = """WITH e AS (SELECT DISTINCT src, dst FROM {dag_patches}), s3 AS (SELECT node, error_raw AS error FROM {dag_nodes} WHERE lvl = 3)"""
for _lvl in (2, 1, 0):
    _below = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(_lvl + 1, 4))
    SATURATE += f""", m{_lvl} AS (SELECT src, max(error) AS child FROM e JOIN ({_below}) b ON b.node = e.dst GROUP BY src),
 s{_lvl} AS (SELECT n.node, CASE WHEN error_raw <= child THEN child * 1.01 ELSE error_raw END AS error FROM {{dag_nodes}} n LEFT JOIN m{_lvl} ON src = n.node WHERE lvl = {_lvl})"""


@query("saturate_errors", SATURATE + " SELECT node, round(error, 5) AS error FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)")
def saturate_errors(at: At) -> DataFrame:
    return rounded(dag.saturate(at["dag_nodes"], at["dag_patches"], "error_raw").select("node", F.col("error_raw").alias("error")))


@query("saturation_violations", "SELECT DISTINCT p.src, p.dst, a.error_raw AS parent_error, b.error_raw AS child_error FROM {dag_patches} p JOIN {dag_nodes} a ON a.node = p.src JOIN {dag_nodes} b ON b.node = p.dst WHERE a.error_raw <= b.error_raw")
def saturation_violations(at: At) -> DataFrame:
    return dag.violations(at["dag_nodes"], at["dag_patches"], "error_raw").select("src", "dst", "parent_error", "child_error")


@query("renumber_subset", "WITH " + CHOSEN + ", i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM c) SELECT patch, a.id AS src, coalesce(b.id, (SELECT count(*) FROM i)) AS dst, tri_end - tri_begin AS ntri FROM {dag_patches} p JOIN i a ON a.node = p.src LEFT JOIN i b ON b.node = p.dst")
def renumber_subset(at: At) -> DataFrame:
    return dag.renumber(chosen(at), at["dag_patches"])


@query("reverse_numbers", "SELECT (SELECT max(dst) FROM {dag_patches}) - src AS src, (SELECT max(dst) FROM {dag_patches}) - dst AS dst, tri_end - tri_begin AS ntri FROM {dag_patches}")
def reverse_numbers(at: At) -> DataFrame:
    return dag.reversed_ids(at["dag_patches"], dag.sink_of(at["dag_patches"]) + 1)


@query("payload_layout", "SELECT node, CAST(sum(bytes) OVER (ORDER BY node) - bytes + 88064 AS BIGINT) AS \"offset\", CAST(bytes AS BIGINT) AS bytes FROM {dag_nodes}")
def payload_layout(at: At) -> DataFrame:
    return dag.layout(at["dag_nodes"], 88000).select("node", F.col("offset").cast("long").alias("offset"), F.col("bytes").cast("long").alias("bytes"))


@query("model_header", """WITH t AS (SELECT * FROM {dag_nodes} WHERE node NOT IN (SELECT dst FROM {dag_patches})), b AS (SELECT (min(cx-radius)+max(cx+radius))/2 AS scx, (min(cy-radius)+max(cy+radius))/2 AS scy, (min(cz-radius)+max(cz+radius))/2 AS scz FROM t)
 SELECT (SELECT CAST(sum(nvert) AS BIGINT) FROM {dag_nodes} WHERE node IN (SELECT src FROM {dag_patches} WHERE dst = """ + SINK + """)) AS nvert, (SELECT CAST(sum(nface) AS BIGINT) FROM {dag_nodes} WHERE node IN (SELECT src FROM {dag_patches} WHERE dst = """ + SINK + """)) AS nface,
 (SELECT count(*) + 1 FROM {dag_nodes}) AS n_nodes, (SELECT count(*) FROM {dag_patches}) AS n_patches, round(scx,5) AS scx, round(scy,5) AS scy, round(scz,5) AS scz, round(max(sqrt(pow(cx-scx,2)+pow(cy-scy,2)+pow(cz-scz,2))+radius),5) AS sradius FROM t, b GROUP BY scx, scy, scz""")
def model_header(at: At) -> DataFrame:
    return rounded(dag.header(at["dag_nodes"], at["dag_patches"]))


@query("node_levels", "WITH RECURSIVE p AS (SELECT dst AS node, max(src) AS parent FROM {dag_patches} WHERE dst <> " + SINK + " GROUP BY dst), l AS (SELECT node, 0 AS level FROM {dag_nodes} WHERE node NOT IN (SELECT dst FROM {dag_patches}) UNION ALL SELECT p.node, l.level + 1 FROM p JOIN l ON p.parent = l.node) SELECT node, level FROM l")
def node_levels(at: At) -> DataFrame:
    return dag.levels(at["dag_nodes"], at["dag_patches"])


@query("adjacency", "SELECT src AS node, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY patch) AS children FROM {dag_patches} GROUP BY src")
def adjacency(at: At) -> DataFrame:
    return dag.adjacency(at["dag_patches"])


@query("integrity", "SELECT (SELECT count(*) FROM {dag_patches} WHERE src NOT IN (SELECT node FROM {dag_nodes})) AS lost_owner, (SELECT count(*) FROM {dag_patches} WHERE dst NOT IN (SELECT node FROM {dag_nodes}) AND dst <> " + SINK + ") AS lost_target, (SELECT count(*) FROM {dag_patches} WHERE dst <= src) AS backward, (SELECT count(*) FROM {dag_nodes} n WHERE nface <> (SELECT max(tri_end) FROM {dag_patches} WHERE src = n.node)) AS bad_count")
def integrity(at: At) -> DataFrame:
    n, p = at["dag_nodes"], at["dag_patches"]
    sink = dag.sink_of(p)
    checks = [
        p.join(n.select(F.col("node").alias("src")), "src", "left_anti").agg(F.count("*").alias("lost_owner")),
        p.filter(F.col("dst") != sink).join(n.select(F.col("node").alias("dst")), "dst", "left_anti").agg(F.count("*").alias("lost_target")),
        p.agg(F.count_if(F.col("dst") <= F.col("src")).alias("backward")),
        n.join(p.groupBy(F.col("src").alias("node")).agg(F.max("tri_end").alias("t")), "node").agg(F.count_if(F.col("t") != F.col("nface")).alias("bad_count")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.crossJoin(c)  # one row each
    return out


@query("node_report", "SELECT node, round(error,5) AS error, radius, nface, lead(off) OVER (ORDER BY node) - off AS size FROM (SELECT *, CAST(sum(bytes) OVER (ORDER BY node) - bytes AS BIGINT) AS off FROM {dag_nodes}) q")
def node_report(at: At) -> DataFrame:
    placed = dag.layout(at["dag_nodes"], 0)
    last = placed.agg(F.max("node")).first()[0]
    size = F.when(F.col("node") != last, F.col("bytes")).cast("long")  # the next node's offset less its own
    return rounded(placed.select("node", "error", "radius", "nface", size.alias("size")))


@query("face_statistics", "SELECT CAST(sum(nface) AS BIGINT) AS total, round(sum(nface) / (count(*) + 1), 5) AS mean, round(sqrt(sum(nface * nface) / (count(*) + 1) - pow(sum(nface) / (count(*) + 1), 2)), 4) AS deviation FROM {dag_nodes}")
def face_statistics(at: At) -> DataFrame:
    """The sink counts as a node without faces."""
    n = F.count("*") + 1
    mean = F.sum("nface") / n
    return at["dag_nodes"].agg(F.sum("nface").alias("total"), r(mean).alias("mean"), r(F.sqrt(F.sum(F.col("nface") * F.col("nface")) / n - mean * mean), 4).alias("deviation"))


@query("level_rollup", "SELECT lvl, count(*) AS nodes, CAST(sum(nface) AS BIGINT) AS faces FROM {dag_nodes} GROUP BY ROLLUP (lvl)")
def level_rollup(at: At) -> DataFrame:
    return at["dag_nodes"].rollup("lvl").agg(F.count("*").alias("nodes"), F.sum("nface").alias("faces"))


@query("payload_sizes", "SELECT node, nvert * 22 + nface * 6 AS ram, round(8.0 * bytes / nvert, 5) AS bits_per_vertex FROM {dag_nodes}")
def payload_sizes(at: At) -> DataFrame:
    return at["dag_nodes"].select("node", (F.col("nvert") * 22 + F.col("nface") * 6).alias("ram"), r(8.0 * F.col("bytes") / F.col("nvert")).alias("bits_per_vertex"))


@query("human_sizes", "SELECT node, CASE WHEN bytes >= 1048576 THEN CAST(CAST(round(bytes / 1048576.0, 1) AS DECIMAL(20,1)) AS VARCHAR) || 'M' WHEN bytes >= 1024 THEN CAST(CAST(round(bytes / 1024.0, 1) AS DECIMAL(20,1)) AS VARCHAR) || 'K' ELSE CAST(CAST(bytes AS DECIMAL(20,1)) AS VARCHAR) || 'B' END AS size FROM {dag_nodes}")
def human_sizes(at: At) -> DataFrame:
    return at["dag_nodes"].select("node", human_bytes(F.col("bytes")).alias("size"))


LEAVES = "(SELECT DISTINCT src AS node FROM {dag_patches} WHERE dst = " + SINK + ")"


def leaves(at: At) -> DataFrame:
    return at["dag_patches"].filter(F.col("dst") == dag.sink_of(at["dag_patches"])).select(F.col("src").alias("node")).distinct()


@query("leaf_box", "SELECT min(cx-radius) AS min_x, max(cx+radius) AS max_x, min(cy-radius) AS min_y, max(cy+radius) AS max_y, min(cz-radius) AS min_z, max(cz+radius) AS max_z FROM {dag_nodes} JOIN " + LEAVES + " l USING (node)")
def leaf_box(at: At) -> DataFrame:
    some = at["dag_nodes"].join(leaves(at), "node", "left_semi")
    return some.agg(*(f(F.col(f"c{c}") + s * F.col("radius")).alias(f"{n}_{c}") for c in "xyz" for n, f, s in (("min", F.min, -1), ("max", F.max, 1))))


@query("coordinate_step", "SELECT round(min(error) * 0.25 / 2, 6) AS step, CAST(trunc(log2(min(error) * 0.25 / 2)) AS INT) AS exponent FROM {dag_nodes} JOIN " + LEAVES + " l USING (node) WHERE error > 0")
def coordinate_step(at: At) -> DataFrame:
    from lodestone.operators.codec import coordinate_step as step

    return rounded(step(at["dag_nodes"], leaves(at), 0.25), 6)


VIEW = "error / (resolution * greatest(sqrt((cx-ex)*(cx-ex)+(cy-ey)*(cy-ey)+(cz-ez)*(cz-ez)) - radius, znear))"


def seen(at: At) -> DataFrame:
    """Every node from every view: views are a stated query set, broadcast where they are few."""
    return at["dag_nodes"].join(small(at["eyes"]))


def screen_error():
    return views.projected_error(F.col("error"), F.col("resolution"), vec("ex", "ey", "ez"), vec("cx", "cy", "cz"), F.col("radius"), F.col("znear"))


@query("view_errors", f"SELECT view, node, round({VIEW}, 3) AS screen_error FROM {{dag_nodes}}, {{eyes}}")
def view_errors(at: At) -> DataFrame:
    return seen(at).select("view", "node", r(screen_error(), 3).alias("screen_error"))


PLANES = "(SELECT * FROM (VALUES (1.0, 0.0, 0.0, 2.0), (-0.6, 0.8, 0.0, 40.0), (0.0, 0.0, 1.0, 1.0)) p(a, b, c, d))"


def planes():
    return F.array(*(F.array(*map(F.lit, p)) for p in ((1.0, 0.0, 0.0, 2.0), (-0.6, 0.8, 0.0, 40.0), (0.0, 0.0, 1.0, 1.0))))


@query("client_view_errors", "SELECT view, node, round(CASE WHEN d < -radius THEN e / 101 WHEN d < 0 THEN e / (1 - d / radius * 100) ELSE e END, 3) AS screen_error FROM (SELECT view, node, radius, error / (resolution * greatest(sqrt((cx-ex)*(cx-ex)+(cy-ey)*(cy-ey)+(cz-ez)*(cz-ez)) - radius, 0.1)) AS e, (SELECT min(a*cx+b*cy+c*cz+d) FROM " + PLANES + ") AS d FROM {dag_nodes}, {eyes}) q")
def client_view_errors(at: At) -> DataFrame:
    e = views.client_error(F.col("error"), F.col("resolution"), vec("ex", "ey", "ez"), vec("cx", "cy", "cz"), F.col("radius"), planes())
    return seen(at).select("view", "node", r(e, 3).alias("screen_error"))


@query("frustum_tests", "SELECT node, round((SELECT min(a*cx+b*cy+c*cz+d) FROM " + PLANES + ") + radius, 5) + 0.0 AS distance, (SELECT min(a*cx+b*cy+c*cz+d + radius) FROM " + PLANES + ") < 0 AS is_outside FROM {dag_nodes}")
def frustum_tests(at: At) -> DataFrame:
    centre = vec("cx", "cy", "cz")
    return at["dag_nodes"].select("node", r(views.plane_distance(planes(), centre, F.col("radius"))).alias("distance"), views.outside(planes(), centre, F.col("radius")).alias("is_outside"))


@query("near_far", "SELECT view, round(greatest(min(sqrt((cx-ex)*(cx-ex)+(cy-ey)*(cy-ey)+(cz-ez)*(cz-ez)) - radius), 0.1), 5) AS near, round(max(sqrt((cx-ex)*(cx-ex)+(cy-ey)*(cy-ey)+(cz-ez)*(cz-ez)) + radius), 5) AS far FROM {dag_nodes}, {eyes} GROUP BY view")
def near_far(at: At) -> DataFrame:
    d = (vec("cx", "cy", "cz") - vec("ex", "ey", "ez")).norm()
    return seen(at).groupBy("view").agg(r(F.greatest(F.min(d - F.col("radius")), F.lit(0.1))).alias("near"), r(F.max(d + F.col("radius"))).alias("far"))


@query("cone_culling", "SELECT node, (cx-3)*0.6 + (cz+40)*0.8 - radius > sqrt(1 - 0.25) * sqrt((cx-3)*(cx-3)+cy*cy+(cz+40)*(cz+40)) AS culled FROM {dag_nodes}")
def cone_culling(at: At) -> DataFrame:
    from lodestone.functions.vectors import Vec

    lit = lambda *v: Vec(*(F.lit(float(x)) for x in v))
    return at["dag_nodes"].select("node", views.backface(lit(0.6, 0, 0.8), F.lit(0.5), lit(3, 0, -40), vec("cx", "cy", "cz"), F.col("radius")).alias("culled"))


@query("view_cut", """WITH RECURSIVE j AS (SELECT view, node, """ + VIEW + """ >= target AS open FROM {dag_nodes}, {eyes}),
 x AS (SELECT view, node FROM j WHERE NOT open AND node IN (SELECT dst FROM {dag_patches}) UNION SELECT view, p.dst FROM {dag_patches} p JOIN x ON x.node = p.src) SELECT view, node FROM j WHERE (view, node) NOT IN (SELECT (view, node) FROM x)""")
def view_cut(at: At) -> DataFrame:
    return dag.view_cut(seen(at), at["dag_patches"], screen_error() >= F.col("target"), "view").select("view", "node")


@query("draw_statistics", "WITH " + CUT + " SELECT (SELECT count(*) FROM c) AS selected, count(DISTINCT src) AS drawn, count(*) AS patches, CAST(sum(tri_end - tri_begin) AS BIGINT) AS rendered FROM k")
def draw_statistics(at: At) -> DataFrame:
    some = chosen(at)
    k = dag.cut(some, at["dag_patches"])
    drawn = k.agg(F.countDistinct("src").alias("drawn"), F.count("*").alias("patches"), F.sum(F.col("tri_end") - F.col("tri_begin")).alias("rendered"))
    return some.agg(F.count("*").alias("selected")).crossJoin(drawn)


@query("top_errors", "SELECT node, round(error, 5) AS error FROM {dag_nodes} ORDER BY error DESC, node LIMIT 20")
def top_errors(at: At) -> DataFrame:
    return rounded(at["dag_nodes"].orderBy(F.desc("error"), "node").limit(20).select("node", "error"))


@query("ray_spheres", """WITH h AS (SELECT ray, node, (cx-ox)*dx+(cy-oy)*dy+(cz-oz)*dz AS t, (cx-ox)*(cx-ox)+(cy-oy)*(cy-oy)+(cz-oz)*(cz-oz) AS d2, radius FROM {rays}, {dag_nodes} JOIN """ + LEAVES + """ l USING (node)),
 k AS (SELECT ray, node, CASE WHEN d2 <= radius*radius THEN 0 ELSE t - sqrt(radius*radius - (d2 - t*t)) END AS distance FROM h WHERE d2 <= radius*radius OR t >= 0 AND d2 - t*t <= radius*radius)
 SELECT ray, round(min(distance), 4) + 0.0 AS distance FROM k GROUP BY ray""")
def ray_spheres(at: At) -> DataFrame:
    return rounded(rays.nearest_spheres(at["rays"], at["dag_nodes"].join(leaves(at), "node", "left_semi")).select("ray", "distance"), 4)


@query("ray_triangles", """WITH q AS (SELECT ray, tri, ox, oy, 50.0 AS oz0, z0, x0, y0, z1, z2, x1, y1, x2, y2 FROM {terrain_s} JOIN (SELECT n_nationkey AS ray, 0.37 + n_nationkey * 3 AS ox, 0.41 + n_regionkey AS oy FROM {nation}) r ON ox >= least(x0,x1,x2) AND ox <= greatest(x0,x1,x2) AND oy >= least(y0,y1,y2) AND oy <= greatest(y0,y1,y2)),
 b AS (SELECT *, ((y1-y2)*(ox-x2)+(x2-x1)*(oy-y2)) / ((y1-y2)*(x0-x2)+(x2-x1)*(y0-y2)) AS l0, ((y2-y0)*(ox-x2)+(x0-x2)*(oy-y2)) / ((y1-y2)*(x0-x2)+(x2-x1)*(y0-y2)) AS l1 FROM q)
 SELECT ray, arg_min(tri, 50 - (l0*z0 + l1*z1 + (1-l0-l1)*z2)) AS tri, round(min(50 - (l0*z0 + l1*z1 + (1-l0-l1)*z2)), 4) AS distance FROM b WHERE l0 >= 0 AND l1 >= 0 AND l0 + l1 <= 1 AND l0*z0 + l1*z1 + (1-l0-l1)*z2 <= 50 GROUP BY ray""")
def ray_triangles(at: At) -> DataFrame:
    d = lambda v: F.lit(float(v))
    down = at["nation"].select(F.col("n_nationkey").alias("ray"), (0.37 + F.col("n_nationkey") * 3).alias("ox"), (0.41 + F.col("n_regionkey")).alias("oy"), d(50).alias("oz"), d(0).alias("dx"), d(0).alias("dy"), d(-1).alias("dz"))
    return rounded(rays.nearest_triangles(down, at["terrain_s"]), 4)


CONTROL = """WITH RECURSIVE o AS (SELECT camera, frame, elapsed_ms, row_number() OVER (PARTITION BY camera ORDER BY frame) AS k FROM {frames}),
 s AS (SELECT camera, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS frame, CAST(15 AS DOUBLE) AS fps, CAST(2 AS DOUBLE) AS error FROM (SELECT DISTINCT camera FROM o)
  UNION ALL SELECT camera, k, frame, fps, least(greatest(error * CASE WHEN 15 / fps > 1.1 THEN 1.05 WHEN 15 / fps < 0.9 THEN 0.95 ELSE 1 END, 2), 15) FROM
   (SELECT o.camera, o.k, o.frame, CASE WHEN elapsed_ms < 500 THEN 0.9 * s.fps + (1 - CAST(0.9 AS DOUBLE)) * (1000 / elapsed_ms) ELSE s.fps END AS fps, s.error FROM o JOIN s ON o.camera = s.camera AND o.k = s.k + 1) q)
 SELECT camera, frame, round(fps, 4) AS fps, round(error, 4) AS current_error FROM s WHERE k > 0"""


@query("frame_control", CONTROL)
def frame_control(at: At) -> DataFrame:
    return rounded(cache.control_frames_arrow(at["frames"].select("camera", "frame", "elapsed_ms")), 4)


@query("frame_control_fold", CONTROL)
def frame_control_fold(at: At) -> DataFrame:
    return rounded(cache.control_frames(at["frames"].select("camera", "frame", "elapsed_ms")), 4)


@query("admission", "SELECT frame // 10 AS frame, arg_max(node, (error, -node)) AS node, max(error) AS error FROM {frames} GROUP BY frame // 10")
def admission(at: At) -> DataFrame:
    return cache.best_candidates(at["frames"].select(F.floor(F.col("frame") / 10).alias("frame"), "node", "error"))


@query("request_states", "SELECT node, count(*) FILTER (kind = 'request') AS requested, count(*) FILTER (kind = 'done') AS done, count(*) FILTER (kind = 'error') AS failed, CASE WHEN count(*) FILTER (kind = 'error') > 2 THEN 0 WHEN count(*) FILTER (kind = 'request') > 0 AND count(*) FILTER (kind = 'request') <= count(*) FILTER (kind = 'done') THEN 1 WHEN count(*) FILTER (kind = 'request') > 0 THEN 2 + count(*) FILTER (kind = 'request') - count(*) FILTER (kind = 'done') ELSE 0 END AS status FROM (SELECT node, CASE frame % 5 WHEN 0 THEN 'request' WHEN 1 THEN 'request' WHEN 4 THEN 'error' ELSE 'done' END AS kind FROM {frames}) GROUP BY node")
def request_states(at: At) -> DataFrame:
    k = F.col("frame") % 5
    return cache.request_states(at["frames"].select("node", F.when(k < 2, "request").when(k == 4, "error").otherwise("done").alias("kind")))


@query("mesh_errors", "SELECT node % 4 AS mesh, frame // 20 AS frame, node, max(error) AS error FROM {frames} GROUP BY ALL")
def mesh_errors(at: At) -> DataFrame:
    return cache.node_errors(at["frames"].select((F.col("node") % 4).alias("mesh"), F.floor(F.col("frame") / 20).alias("frame"), "node", "error"))


@query("priorities", "SELECT node, max(frame) AS frame, arg_max(error, frame) AS error FROM {frames} GROUP BY node")
def priorities(at: At) -> DataFrame:
    return cache.priorities(at["frames"])


@query("prefetch", "SELECT node FROM {dag_nodes} WHERE error < 3 ORDER BY error DESC, node LIMIT 200")
def prefetch(at: At) -> DataFrame:
    return cache.prefetch(at["dag_nodes"], F.col("error") < 3).select("node")


@query("progress", "SELECT camera, frame, CAST(sum(frame % 3) OVER (PARTITION BY camera ORDER BY frame) AS BIGINT) AS available FROM {frames}")
def progress(at: At) -> DataFrame:
    return cache.progress(at["frames"].select("camera", "frame", (F.col("frame") % 3).alias("arrived"))).select("camera", "frame", "available")


@query("cache_log")
def cache_log(at: At) -> DataFrame:
    """The state machine of one cache a camera; tests replay it."""
    requests = at["frames"].select("camera", F.floor(F.col("frame") / 20).alias("frame"), "node", "error", (F.lit(10_000) + F.col("node") % 97 * 100).alias("bytes"))
    return cache.simulate(requests, 100_000)


@query("frame_windows", "SELECT camera, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS frames, max(error) AS error FROM {frames} GROUP BY ALL")
def frame_windows(at: At) -> DataFrame:
    w = at["frames"].groupBy("camera", F.window("ts", "1 hour")).agg(F.count("*").alias("frames"), F.max("error").alias("error"))
    return w.select("camera", F.col("window.start").cast("timestamp_ntz").alias("start"), "frames", "error")


@query("shuffled_points", "SELECT pid, node, row_number() OVER (PARTITION BY node ORDER BY md5(concat_ws(':', 0, node, pid)), pid) - 1 AS place FROM {cloud}")
def shuffled_points(at: At) -> DataFrame:
    from lodestone.operators.codec import shuffled

    return shuffled(at["cloud"]).select("pid", "node", "place")
