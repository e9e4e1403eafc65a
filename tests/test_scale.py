"""Faults that only larger tables show, each on the least rows that have it."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import session
from lodestone.functions import bits
from lodestone.operators import dag, partition, rays
from lodestone.plans import build_queries, builder, client_queries, dag_queries, mesh_queries, registry  # noqa: F401
from lodestone.plans import fixtures
from lodestone.plans.fixtures import frame
from lodestone.sources import text_meshes


@pytest.fixture
def orders(spark, tmp_path):
    """A folder with orders of the given keys."""

    def put(*keys):
        rows = [(k, k % 70, 1000.0 + k % 977) for k in keys]
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
        return str(tmp_path)

    return put


def test_morton_of_many_rows(spark, orders):
    where = orders(0, 7, *((1 << b) + d for b in (20, 21, 22, 26, 41, 42, 50) for d in (-1, 0, 5)))
    with duckdb.connect() as con:
        con.execute(f"create view orders as select * from '{where}/orders.parquet/*.parquet'")
        want = con.sql(registry.ORACLES["morton_round_trip"]).fetchall()
    got = registry.QUERIES["morton_round_trip"](spark, where).select("vid", "x", "y", "z")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    keyed = spark.range(200).select((F.col("id") * 7919 % 200 * (1 << 17)).alias("v"))
    coded = keyed.select("v", bits.morton_words(F.col("v"), F.lit(3), F.lit(1 << 30)).alias("code"))
    assert [r.v for r in coded.orderBy("code").collect()] == [k << 17 for k in range(200)]


def test_small_cells_need_no_rounds(spark, sf, monkeypatch):
    points = frame(spark, sf, "terrain_v").select("vid", "x", "y", "z")
    rounds, planes = [], partition.approximate_planes
    monkeypatch.setattr(partition, "approximate_planes", lambda *a: rounds.append(1) or planes(*a))
    at_once = {r.vid: r.cell for r in partition.kd_partition(points, 50).collect()}
    assert len(rounds) == 1
    by_rounds = {r.vid: r.cell for r in partition.kd_partition(points, 50, held=50).collect()}
    assert len(rounds) > 5 and by_rounds == at_once
    odd = spark.createDataFrame([(i, float(i % 7), float("nan") if i == 3 else 1.0, None if i == 5 else 2.0) for i in range(60)], "vid long, x double, y double, z double")
    cells = partition.kd_partition(odd, 20).groupBy("cell").count().collect()
    assert sum(r["count"] for r in cells) == 60 and max(r["count"] for r in cells) <= 20


def test_blocks_are_dealt_by_number(spark):
    blocks = spark.range(4000).select((F.col("id") % 300).alias("block"), F.col("id").cast("double").alias("x0"))
    tasks = lambda n: builder._dealt(blocks.filter(F.col("block") < n), n).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(300) > 15 and tasks(1) == 1


@pytest.fixture
def apart(spark):
    """Adaptive execution leaves small partitions apart, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def most_in_a_task(df, column):
    each = df.select(column, F.spark_partition_id().alias("task")).groupBy("task").agg(F.count(column).alias("n"))
    return each.agg(F.max("n") / F.sum("n")).first()[0]


def test_patches_are_not_one_task(spark, sf, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, write = [], session.materialize
    monkeypatch.setattr(fixtures, "materialize", lambda df, name: plans.append(plan(df)) or write(df, name), raising=False)
    plans.append(plan(frame(spark, sf, "dag_patches")))
    numbered = [line for text in plans for line in text.splitlines() if "row_number()" in line]
    assert numbered and all(re.search(r"\], \[src#\d+L?\], \[dst#", line) for line in numbered)  # a window a node


def test_patches_are_the_rows_of_their_text(spark, sf, tmp_path):
    known = {name: frame(spark, sf, name) for name in ("region", "nation", "supplier", "part")}
    lines = frame(spark, sf, "lineitem")
    lost = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_suppkey"))  # some lines without a supplier
    known["lineitem"] = lines.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 3 == 0, 4).otherwise(lost))  # one with a third of them
    by_text = dict(known)
    for name in ("dag_base", "dag_edges", "dag_edges_all", "dag_patches", "dag_nodes"):
        by_text[name] = fixtures._by_sql(name, by_text.__getitem__)
    for name in ("dag_patches", "dag_nodes"):
        got = frame(spark, sf, name, known)
        assert got.columns == by_text[name].columns and [t for _, t in got.dtypes] == [t for _, t in by_text[name].dtypes]
        assert got.exceptAll(by_text[name]).isEmpty() and by_text[name].exceptAll(got).isEmpty()


def test_saturation_writes_a_node_once(spark, sf, monkeypatch):
    known = {}
    nodes, patches = (frame(spark, sf, name, known) for name in ("dag_nodes", "dag_patches"))
    for run, name in ((dag.saturate, "saturated"), (dag.saturate_spheres, "spheres")):
        written, write = [], dag.materialize
        with monkeypatch.context() as m:
            m.setattr(dag, "materialize", lambda df, what: written.append((what, df.count())) or write(df, what))
            assert run(nodes, patches).count() == nodes.count()
        assert sum(n for what, n in written if what == name) == nodes.count()
        assert [n for what, n in written if what == "edges"] == [patches.count()]


def test_a_scene_is_read_once(spark, sf):
    reads = spark.sparkContext.accumulator(0)

    def counted(v):
        reads.add(1)
        return v

    soup = frame(spark, sf, "terrain_s")
    n = soup.count()
    down = spark.createDataFrame([(1, 5.2, 3.1, 90.0, 0.0, 0.0, -1.0)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    hits = rays.nearest_triangles(down, soup.withColumn("z0", F.udf(counted, "double")("z0"))).collect()
    assert len(hits) == 1 and reads.value == n


def test_lines_of_one_file_are_many_tasks(spark, apart):
    texts = ["v" if i % 10 else f"usemtl m{i}" for i in range(1, 4000)]
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)] + [("b", 0, "v"), ("b", 1, "usemtl x"), ("b", 2, "v"), ("c", 0, "v")], "path string, line long, text string")
    got = text_meshes.carry_forward(rows, r"^usemtl (\S+)", "material")
    want, now = {}, None
    for i, t in enumerate(texts):
        now = t[7:] if t != "v" else now
        want["a", i] = now
    want |= {("b", 0): None, ("b", 1): "x", ("b", 2): "x", ("c", 0): None}
    assert {(r.path, r.line): r.material for r in got.collect()} == want
    assert most_in_a_task(got, "material") < 0.6
    once = spark.createDataFrame([("a", i, "usemtl m" if i == 2 else "v") for i in range(3000)], "path string, line long, text string")
    assert text_meshes.carry_forward(once, r"^usemtl (\S+)", "material").filter("material is null").count() == 2
