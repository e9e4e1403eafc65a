"""Queries that build a model and that drain streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.builder import BuildOptions, build, build_cloud
from lodestone.plans.dag_queries import CONTROL
from lodestone.plans.registry import At, query, rounded
from lodestone.streaming import frames


@query("build_model")
def build_model(at: At) -> DataFrame:
    """Nodes of a model of the whole terrain; tests hold its invariants."""
    nodes, _, _ = build(at["terrain_s"], BuildOptions(node_faces=2000, top_faces=500))
    return rounded(nodes.select("node", "lvl", "error", "nvert", "nface", "radius"))


ENDS = [(f, c) for c in "xyz" for f in ("least", "greatest")]


@query("build_model_leaves", "SELECT " + ", ".join(f"{f}({c}0, {c}1, {c}2) AS {f}_{c}" for f, c in ENDS) + ", count(*) AS faces FROM {terrain_s} GROUP BY ALL")
def build_model_leaves(at: At) -> DataFrame:
    """The triangles of the finest level are those of the input, each once."""
    _, patches, triangles = build(at["terrain_s"], BuildOptions(node_faces=2000, top_faces=500))
    sink = patches.agg(F.max("dst")).first()[0]
    ends = [getattr(F, f)(*(F.col(f"{c}{k}") for k in range(3))).alias(f"{f}_{c}") for f, c in ENDS]
    return triangles.filter(F.col("dst") == sink).groupBy(*ends).agg(F.count("*").alias("faces"))


@query("build_cloud_points", "SELECT vid AS pid, 1 AS nodes, TRUE AS within FROM {terrain_v}")
def build_cloud_points(at: At) -> DataFrame:
    """Every point of a cloud is in one node of its model, inside the node's sphere."""
    nodes, _, points = build_cloud(at["terrain_v"].select(F.col("vid").alias("pid"), "x", "y", "z"), BuildOptions(node_faces=600, top_faces=200))
    apart = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0)))
    placed = points.join(nodes.select("node", "cx", "cy", "cz", "radius"), "node").withColumn("held", apart <= F.col("radius") + 1e-9)
    return placed.groupBy("pid").agg(F.count("*").cast("int").alias("nodes"), F.bool_and("held").alias("within"))


@query("stream_control", CONTROL)
def stream_control(at: At) -> DataFrame:
    log = frames.request_log(at.spark, f"{at.sf_dir}/events.parquet")
    return rounded(frames.drained(frames.control(log.select("camera", "frame", "elapsed_ms"))), 4)


@query("stream_windows", "SELECT camera, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS frames, max(error) AS error FROM {frames} GROUP BY ALL")
def stream_windows(at: At) -> DataFrame:
    out = frames.drained(frames.windowed(frames.request_log(at.spark, f"{at.sf_dir}/events.parquet")), "complete")
    return out.select("camera", F.col("start").cast("timestamp_ntz").alias("start"), "frames", "error")
