"""Named queries over the fixtures, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.fixtures import frame, oracle
from lodestone.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class At:
    """Tables and fixtures of one data directory by name: at["cloud"]."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name, self.known)


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(at) -> DataFrame under a name, and the SQL that gives the same rows."""

    def put(f: Callable[[At], DataFrame]) -> Callable[[At], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(At(prepare(spark), sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return put


def r(c: Column | str, digits: int = 5) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """All double columns rounded."""
    return df.select(*(r(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
