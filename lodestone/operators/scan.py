"""Distributed prefix sums and ranks over a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import materialize

#: Rows up to which the other side of a join is broadcast; its size is always checked.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df plus _range: rows cut into as many ranges of the order as there are shuffle partitions. To be written before it is read twice, which fixes the numbers."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())


def prefix_sum(df: DataFrame, value: str, first: Column, *then: Column, descending: bool = False, name: str = "running") -> DataFrame:
    """df plus the inclusive running sum of value in the order of first (numeric; descending if so told), then the rest.

    A single global window would put all rows into one task. Here rows are cut into ranges of the
    whole sort key, as many as there are shuffle partitions; ranges are summed by a small
    aggregate, and each one's rows are summed behind its base."""
    key = -first if descending else first
    orders = {"_key": key, **{f"_then{i}": c for i, c in enumerate(then)}}
    cut = materialize(ranged(df.withColumns(orders), *orders), "ranges")
    sums = cut.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(before), "_range")  # a row a range
    return joined.withColumn(name, F.sum(value).over(inside) + F.col("_base")).drop(*orders, "_range", "_base")


def dense_number(df: DataFrame, first: Column, *then: Column, name: str = "number") -> DataFrame:
    """df plus 0-based row numbers in a total order."""
    counted = prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", first, *then, name=name)
    return counted.withColumn(name, F.col(name) - 1).drop("_one")
