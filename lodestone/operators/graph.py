"""Graph operators: components and closures by joins, a table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of edges (a, b), every id that has an edge: the least id reachable. Minimum labels with pointer jumping until no label falls."""
    ends = edges.filter("a is not null and b is not null")
    both = materialize(ends.select("a", "b").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("root"))
        moved = materialize(lower.join(jump, "component").select("id", F.col("root").alias("component"), (F.col("root") != F.col("before")).alias("moved")), "labels")
        labels = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return labels


def descendants(edges: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """(keys.., node): everything reachable along edges (src, dst) from of (keys.., node), itself included, for each value of keys apart."""
    found = frontier = materialize(of.select(*keys, "node").distinct(), "reach")
    while True:
        step = edges.join(frontier.withColumnRenamed("node", "src"), "src").select(*keys, F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(found, [*keys, "node"], "left_anti"), "reach")
        if frontier.isEmpty():
            return found
        found = materialize(found.union(frontier), "reach")
