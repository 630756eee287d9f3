import math

import duckdb
import pytest

import __spark_entry__ as entry
from framesift.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for name in TABLES:
        made.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    return made


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 20 * -(-spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count() // 50)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_submission_faults_of_all_rows(spark, sf):
    last = spark.read.parquet(f"{sf}/embeddings.parquet").agg({"vec_id": "max"}).first()[0]
    found = {(int(x.task_id[1:]), x.fault) for x in QUERIES["validate_submission"](spark, sf).collect()}
    assert {f for t, f in found if t >= 10} == {
        "more than 10 results", "ranks are not 1 to n", "invalid video_id", "duplicate video_id", "frame_ms is negative", "unknown video_id"}
    assert max(t for t, _ in found) >= last // 10 - 5
