"""Every query against its SQL in DuckDB, on sf0.01."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, name):
    want = con.sql(queries.SQL[name])
    got = queries.FOUND[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda found, names: sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in found)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types)))


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(queries.SQL) == set(queries.FOUND)
    assert __spark_entry__.entry(spark).count() == queries.LIMIT
