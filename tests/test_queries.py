"""Queries against their DuckDB oracles on the smallest tables."""

import functools
import os

import duckdb
import pytest

import __spark_entry__ as entry
from orderloom.plans import changes, expressions, files, warehouse

SF = "/root/testdata/sf0.001"
ORACLE = {k: s for p in (warehouse, expressions, changes, files) for k, s in p.oracle_sql().items()}
QUERIES = {k: f for p in (warehouse, expressions, changes, files) for k, f in p.queries().items()}


@functools.cache
def database():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def key(rows):
    return sorted(str(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    c = database()
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = c.sql(f"select {', '.join(names)} from ({ORACLE[name]})").fetchall()
    assert key(map(tuple, df.select(*names).collect())) == key(want)


def test_every_query_is_callable():
    assert all(callable(f) for f in entry.queries().values())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
