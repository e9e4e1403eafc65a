"""Every query with a DuckDB counterpart gives the same rows."""

import math
import os

import duckdb
import pytest

from lodestone.plans import build_queries, client_queries, dag_queries, mesh_queries, registry  # noqa: F401


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
