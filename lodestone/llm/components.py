"""Distributed union-find: trees within partitions, then alternating large-star and small-star steps.

Every partition joins its edges by union-find and hands on one edge a node. If at most TASK_EDGES
are left, one more such pass in a single task ends it; that bound, not the input, is what a task
holds. Otherwise rounds of star steps follow, in DataFrame operations: each is a keyed minimum
(partially aggregated before the shuffle) and an equi-join with one row a key on the other side,
so adaptive execution can split a hub's edges over several tasks; none holds more than a row of
them at a time. Nothing about the graph reaches the driver but counts. Each round is written to
the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize

#: Edges that a task joins at a time.
TASK_EDGES = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges (a, b): every node but the least of its component, and that one. Minimum labels that jump."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)  # in order, so labels are least ids
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):  # the root of either end takes the lower label
            np.minimum.at(label, before[end], low)
            np.minimum.at(label, end, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
        if (label[a] == label[b]).all():
            break
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def forest(edges: DataFrame, kind: str) -> DataFrame:
    """edges (a, b) of each partition as stars (a, b), a > b, of its components (TASK_EDGES edges at a time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def joined() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held)))], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)))
            size += batch.num_rows
            if size >= TASK_EDGES:
                yield joined()
                held, size = [], 0
        if size:
            yield joined()

    return edges.mapInArrow(run, f"a {kind}, b {kind}")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b, to such edges, some maybe twice. Large: higher neighbours go to the least of a node and all its neighbours. Small: a node and its lower neighbours go to the least of them."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("low"))
    if large:
        least = least.withColumn("low", F.least("low", "u"))
        near = near.filter(F.col("v") > F.col("u"))
        return near.join(least, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    moved = near.join(least, "u").filter(F.col("v") != F.col("low")).select(F.col("v").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("low").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): component is the least id reachable; only ids with an edge to another id appear. Null ends are ignored."""
    low, high = F.least(a, b), F.greatest(a, b)
    now = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("a"), low.alias("b"))
    kind = dict(now.dtypes)["a"]
    if kind in ("bigint", "int"):  # ids of other types go through the star steps alone
        now = materialize(forest(now, kind), "forest")
        if now.count() <= TASK_EDGES:
            return _rows(materialize(forest(now.coalesce(1), kind), "forest"))
    now = materialize(now.distinct(), "edges")
    while True:
        # done when what is left are stars: no lower end has an edge further down, and no node two edges
        further = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        if further.limit(1).union(now.groupBy("a").count().filter("count > 1").select("a").limit(1)).isEmpty():
            return _rows(now)
        now = materialize(_star(_star(now, True), False).distinct(), "star")


def _rows(now: DataFrame) -> DataFrame:
    """Stars (a, b) as (id, component), the least ids included."""
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
