"""Geometry derived from ordinary tables, as SQL that Spark and DuckDB both run.

In the text a name in braces is a table or another fixture.
"""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.scan import prefix_sum
from lodestone.session import materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES = {
    "terrain_v": """SELECT o_orderkey AS vid, CAST(o_orderkey % 100 AS DOUBLE) AS x, CAST(floor(o_orderkey / 100.0) AS DOUBLE) AS y,
       o_totalprice / 10000.0 AS z, CAST(o_orderkey % 256 AS INT) AS r, CAST(o_custkey % 256 AS INT) AS g, CAST((o_orderkey * 7) % 256 AS INT) AS b FROM {orders}""",
    "terrain_f": """SELECT 2*v AS tri, v AS i0, v+1 AS i1, v+100 AS i2 FROM (SELECT o_orderkey AS v FROM {orders}) t WHERE v % 100 < 99 AND v + 101 < (SELECT count(*) FROM {orders})
       UNION ALL SELECT 2*v+1, v+1, v+101, v+100 FROM (SELECT o_orderkey AS v FROM {orders}) t WHERE v % 100 < 99 AND v + 101 < (SELECT count(*) FROM {orders})""",
    "terrain_s": """SELECT f.tri, CAST(floor(f.tri / 500.0) AS BIGINT) AS node, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2
       FROM {terrain_f} f JOIN {terrain_v} a ON a.vid = f.i0 JOIN {terrain_v} b ON b.vid = f.i1 JOIN {terrain_v} c ON c.vid = f.i2""",
    "cloud": """SELECT vec_id AS pid, CAST(EL(embedding,1) AS DOUBLE) AS x, CAST(EL(embedding,2) AS DOUBLE) AS y, CAST(EL(embedding,3) AS DOUBLE) AS z,
       CAST(EL(embedding,4) AS DOUBLE) AS nx, CAST(EL(embedding,5) AS DOUBLE) AS ny, CAST(EL(embedding,6) AS DOUBLE) AS nz, CAST(label AS BIGINT) AS node FROM {embeddings}""",
    "soup": """SELECT a.pid AS tri, a.node AS node, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2
       FROM {cloud} a JOIN {cloud} b ON b.pid = a.pid + 1 JOIN {cloud} c ON c.pid = a.pid + CASE WHEN a.pid % 50 = 0 THEN 1 ELSE 2 END""",
    "dag_base": """SELECT CAST(r_regionkey AS BIGINT) AS node, 0 AS lvl, CAST(10.0 + r_regionkey AS DOUBLE) AS error, CAST((r_regionkey*7919) % 1000 AS DOUBLE)/100 AS error_raw,
       CAST(r_regionkey*10 AS DOUBLE) AS cx, CAST(0 AS DOUBLE) AS cy, CAST(0 AS DOUBLE) AS cz, CAST(20 AS DOUBLE) AS radius, CAST(400 AS BIGINT) AS nvert FROM {region}
       UNION ALL SELECT CAST(5 + n_nationkey AS BIGINT), 1, 5 + CAST(n_nationkey AS DOUBLE)/10, CAST((n_nationkey*7919) % 1000 AS DOUBLE)/100, CAST(n_nationkey AS DOUBLE), CAST(n_regionkey AS DOUBLE), CAST(0 AS DOUBLE), CAST(5 AS DOUBLE), CAST(300 AS BIGINT) FROM {nation}
       UNION ALL SELECT 30 + s_suppkey, 2, 2 + CAST(s_suppkey % 13 AS DOUBLE)/10, CAST((s_suppkey*7919) % 1000 AS DOUBLE)/100, CAST(s_suppkey % 50 AS DOUBLE), CAST(s_nationkey AS DOUBLE), CAST(floor(s_acctbal/1000) AS DOUBLE), CAST(2 AS DOUBLE), CAST(200 AS BIGINT) FROM {supplier}
       UNION ALL SELECT 30 + (SELECT count(*) FROM {supplier}) + p_partkey, 3, CAST(0.5 AS DOUBLE) + CAST(p_partkey % 97 AS DOUBLE)/100, CAST((p_partkey*7919) % 1000 AS DOUBLE)/100, CAST(p_size AS DOUBLE), CAST(p_partkey % 100 AS DOUBLE), CAST(p_partkey % 50 AS DOUBLE), CAST(1 AS DOUBLE), CAST(50 + p_partkey % 60 AS BIGINT) FROM {part}""",
    "dag_edges": """SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(5 + n_nationkey AS BIGINT) AS dst, CAST(20 AS BIGINT) AS ntri FROM {nation}
       UNION ALL SELECT CAST(5 + s_nationkey AS BIGINT), 30 + s_suppkey, 10 + s_suppkey % 7 FROM {supplier}
       UNION ALL SELECT 30 + l_suppkey, 30 + (SELECT count(*) FROM {supplier}) + l_partkey, count(*) FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "dag_edges_all": """SELECT src, dst, ntri FROM {dag_edges}
       UNION ALL SELECT b.node, (SELECT 30 + (SELECT count(*) FROM {supplier}) + (SELECT count(*) FROM {part})), CAST(5 + b.node % 11 AS BIGINT)
       FROM {dag_base} b LEFT JOIN (SELECT DISTINCT src FROM {dag_edges}) e ON e.src = b.node WHERE e.src IS NULL""",
    "dag_patches": """SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS BIGINT) AS patch, src, dst,
       CAST(sum(ntri) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) - ntri AS BIGINT) AS tri_begin,
       CAST(sum(ntri) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tri_end FROM {dag_edges_all}""",
    "dag_nodes": """SELECT b.node, b.lvl, b.error, b.error_raw, b.cx, b.cy, b.cz, b.radius, b.nvert, p.nface, p.first_patch,
       ((b.nvert*12 + p.nface*6 + 255) - (b.nvert*12 + p.nface*6 + 255) % 256) AS bytes
       FROM {dag_base} b JOIN (SELECT src, max(tri_end) AS nface, min(patch) AS first_patch FROM {dag_patches} GROUP BY src) p ON p.src = b.node""",
    "frames": """SELECT event_id AS frame, ts, CAST(user_id % 8 AS BIGINT) AS camera, user_id AS node, CAST(10 + event_id % 90 AS DOUBLE) AS elapsed_ms, value AS error, event_type AS kind FROM {events}""",
    "rays": """SELECT CAST(n_nationkey AS BIGINT) AS ray, CAST(n_nationkey * 2 AS DOUBLE) AS ox, CAST(n_regionkey AS DOUBLE) AS oy, CAST(-5 AS DOUBLE) AS oz, CAST(0 AS DOUBLE) AS dx, CAST(0.6 AS DOUBLE) AS dy, CAST(0.8 AS DOUBLE) AS dz FROM {nation}""",
    "eyes": """SELECT CAST(r_regionkey AS BIGINT) AS view, CAST(r_regionkey * 5 AS DOUBLE) AS ex, CAST(3 AS DOUBLE) AS ey, CAST(10 + r_regionkey * 40 AS DOUBLE) AS ez, CAST(0.002 AS DOUBLE) AS resolution, CAST(0.1 AS DOUBLE) AS znear, CAST(20 AS DOUBLE) AS target FROM {region}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _edges(get: Callable[[str], DataFrame]) -> DataFrame:
    """Written once: edges stand under nodes and patches, in several places.

    Nearly every line has a pair of its own, so that sums before the shuffle only hold memory: lines are dealt by pair first."""
    lines = get("lineitem").select("l_suppkey", "l_partkey")
    dealt = lines.repartition(_partitions(lines), "l_suppkey", "l_partkey")
    return materialize(_by_sql("dag_edges", lambda n: dealt if n == "lineitem" else get(n)), "edges")


def _owners(get: Callable[[str], DataFrame]) -> DataFrame:
    """(src, n, tri_end, patch): how many patches and triangles a node has, and its first patch, by a prefix sum over nodes."""
    counted = get("dag_edges_all").groupBy("src").agg(F.count("*").alias("n"), F.sum("ntri").alias("tri_end"))
    placed = prefix_sum(counted, "n", F.col("src"), name="patch").withColumn("patch", F.col("patch") - F.col("n"))
    return materialize(placed, "owners")


def _patches(get: Callable[[str], DataFrame]) -> DataFrame:
    """The text's rows, numbered within each node behind the first patch of the node: its global window is one task."""
    w = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    edges = get("dag_edges_all")
    own = edges.repartition(_partitions(edges), "src").withColumns({"at": F.row_number().over(w), "tri_end": F.sum("ntri").over(w)})
    first = F.coalesce("patch", F.lit(0))  # a null comes before all
    placed = own.join(get("dag_owners").select("src", "patch"), "src", "left").select((first + F.col("at") - 1).alias("patch"), "src", "dst", (F.col("tri_end") - F.col("ntri")).alias("tri_begin"), "tri_end")
    return materialize(placed, "patches")


def _nodes(get: Callable[[str], DataFrame]) -> DataFrame:
    """The text over a row a node in place of its patches: their last end and first number are the same."""
    return materialize(_by_sql("dag_nodes", lambda n: get("dag_owners" if n == "dag_patches" else n)), "nodes")


#: Fixtures that Spark makes in another way than their text, with the same rows.
BUILT = {"dag_edges": _edges, "dag_owners": _owners, "dag_patches": _patches, "dag_nodes": _nodes}


def _by_sql(name: str, get: Callable[[str], DataFrame]) -> DataFrame:
    text = re.sub(r"EL\((\w+),(\d+)\)", r"element_at(\1,\2)", FIXTURES[name])
    needed = {n: get(n) for n in dict.fromkeys(_NAME.findall(text))}
    return next(iter(needed.values())).sparkSession.sql(text, **needed)


def frame(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table or fixture as a DataFrame."""
    known = {} if known is None else known
    if name not in known:
        get = lambda n: frame(spark, sf_dir, n, known)
        if name in TABLES:
            known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            known[name] = BUILT[name](get) if name in BUILT else _by_sql(name, get)
    return known[name]


def oracle(sql: str) -> str:
    """DuckDB SQL with the fixtures it names in braces as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _NAME.findall(text):
            if name in FIXTURES and name not in order:
                need(FIXTURES[name])
                order.append(name)

    need(sql)
    plain = lambda t: _NAME.sub(r"\1", re.sub(r"EL\((\w+),(\d+)\)", r"\1[\2]", t))
    parts = [f"{n} AS ({plain(FIXTURES[n])})" for n in order]
    body = plain(sql).strip()
    if not parts:
        return body
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[len("WITH RECURSIVE") :]
    if re.match(r"WITH\b", body, re.I):
        return "WITH " + ", ".join(parts) + ", " + body[len("WITH") :]
    return "WITH " + ", ".join(parts) + " " + body
