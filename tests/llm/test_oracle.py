"""The training-data queries that SQL can express, against DuckDB over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from cargoscope.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = db.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns).collect()
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)
