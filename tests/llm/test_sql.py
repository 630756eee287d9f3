"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from framesift.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["op3_near_duplicates", "shard_counts", "shard_sizes", "licence_places"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
