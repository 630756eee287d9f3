import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from framesift.llm import kdtree
from framesift.llm.queries import OP6_SQL, op6_kdtree


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.sql(OP6_SQL).fetchall()
    assert sorted(map(tuple, op6_kdtree(spark, sf).collect())) == sorted(want) and len(want) == 50


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 3 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_shards_blocks_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for k in range(200)]
    rows += [(300 + k, rows[5][1]) for k in range(30)]  # ties
    rows += [(400 + k, [float(x) for x in rng.integers(-3, 4, 3) / 4]) for k in range(60)] + [(500, [1.0]), (501, [2.0]), (502, [0.5])]  # lengths
    rows += [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("score", "shard", "id", "v", "times", "leaf")})
    want = brute(rows, 5)
    for shard_rows in (10_000, 40, 7):
        got = kdtree.top_k(df, F.col("id") % 3 == 0, shard_rows=shard_rows).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert kdtree.top_k(df.limit(0), F.col("id") % 3 == 0).count() == 0
    assert kdtree.top_k(df.where("vec_id < 2"), F.col("id") % 3 == 0).count() == 1


def test_scores_beyond_double_are_exact(spark):
    rows = [(0, [3.0e6, 1.0]), (1, [3.0e6, 2.0]), (2, [3.0e6, 1.0]), (3, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, kdtree.top_k(df, F.col("id") % 3 == 0).collect())) == sorted(brute(rows, 5))


def test_a_third_of_all_vectors_are_equal(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [0.5, 0.25, -1.0] if k % 3 else [float(x) for x in rng.normal(size=3)]) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    assert sorted(map(tuple, kdtree.top_k(df, F.col("id") % 3 == 0, shard_rows=50).collect())) == sorted(brute(rows, 5))


def test_a_repeated_id_is_a_candidate_each_time(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0])] * 9 + [(1, [1.0, 0.0])] * 7 + [(2, [0.5, 0.0])], "vec_id long, embedding array<double>")
    got = kdtree.top_k(df, F.col("id") % 2 == 0).collect()
    assert sorted((x.query_id, x.rank, x.vec_id) for x in got) == [(0, r, 1) for r in range(1, 6)] + [(2, r, 0) for r in range(1, 6)]


def test_bounds_keep_queries_from_shards():
    """Splits deal neighbours together, so boxes are small and bounds tell shards apart."""
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(size=(200, 2)) + 20 * c for c in rng.normal(size=(8, 2))])
    splits = kdtree.Splits(rows, 8)
    leaf = splits.leaf_of(rows)
    assert splits.leaves == 8 and np.bincount(leaf).min() >= 100
    volume = sum(np.prod(rows[leaf == k].max(0) - rows[leaf == k].min(0)) for k in range(8))
    assert volume < 0.5 * np.prod(rows.max(0) - rows.min(0))
