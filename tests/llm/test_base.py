"""What SQL can express of operators 1, 2 and 6, against DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from quillspark.llm import base


def plain(v):
    return repr(None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v)


@pytest.mark.parametrize("folder", ["edge", "/root/testdata/sf0.001"])
@pytest.mark.parametrize("name", sorted(base.SQL))
def test_against_sql(spark, sf, name, folder):
    d = sf if folder == "edge" else folder
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet{'/*.parquet' if folder == 'edge' else ''}'")
    want = con.sql(base.SQL[name])
    got = base.FOUND[name](spark, d).select(*want.columns)
    rows = lambda found: sorted([plain(v) for v in r] for r in found)
    assert rows(map(tuple, got.collect())) == rows(want.fetchall())
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert [kinds[t] for _, t in got.dtypes] == list(map(str, want.types))
