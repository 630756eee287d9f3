import duckdb
import numpy as np
from pyspark.sql import functions as F

from framesift.llm import embedding_dedup as ed
from framesift.llm.queries import OP9_SQL, op9_embedding_dedup


def brute(ids, vectors, threshold):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return near.sum(1), label
        label = new


def test_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    n, label = brute(table.vec_id.tolist(), np.stack(table.embedding).astype(float), 0.9)
    got = {x.vec_id: x for x in op9_embedding_dedup(spark, sf).collect()}
    assert len(got) == len(table)
    links = np.array([got[i].n_links for i in table.vec_id])
    assert (links <= n).all() and links.sum() >= 0.97 * n.sum()
    assert np.mean([got[i].component_id == c for i, c in zip(table.vec_id, label)]) > 0.97
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_recall_just_at_the_threshold(spark):
    rng, d = np.random.default_rng(2), 48
    a = rng.normal(size=(300, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(300, d))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = np.concatenate([a, 0.902 * a + np.sqrt(1 - 0.902**2) * b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pairs)], "vec_id long, embedding array<double>")
    found = sum(x.n_links for x in ed.link(df).collect())
    n, _ = brute(list(range(600)), pairs, 0.9)
    assert 0.95 * n.sum() <= found <= n.sum()


def test_recall_of_vectors_off_centre(spark):
    """All vectors share a direction: pairs are wider apart about the mean than about the origin."""
    rng, d, n = np.random.default_rng(3), 64, 1000
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    for common in (0.5, 0.7):
        a, b = unit(rng.normal(size=(n, d))), rng.normal(size=(n, d))
        c = (0.903 - common) / (1 - common)
        b = c * a + np.sqrt(1 - c**2) * unit(b - (a * b).sum(1, keepdims=True) * a)
        pairs = unit(np.sqrt(common) * unit(rng.normal(size=(1, d))) + np.sqrt(1 - common) * np.concatenate([a, b]))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pairs)], "vec_id long, embedding array<double>")
        found = sum(x.n_links for x in ed.link(df).collect())
        links, _ = brute(list(range(2 * n)), pairs, 0.9)
        assert links.sum() > n / 2 and 0.98 * links.sum() <= found <= links.sum(), (common, found, links.sum())


def test_large_groups_split_into_blocks(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = np.concatenate([base + 0.01 * rng.normal(size=(150, 16)), rng.normal(size=(40, 16))])
    table = [(i, v.tolist()) for i, v in enumerate(rows)] + [(500, rows[0].tolist()), (500, rows[0].tolist()), (501, (2 * rows[0]).tolist())]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    for block in (4096, 20):
        got = sorted(map(tuple, ed.link(df, block=block).collect()))
        n, label = brute([t[0] for t in table], np.array([t[1] for t in table]), 0.9)
        assert got == sorted((t[0], int(k), int(c), t[0] == c) for t, k, c in zip(table, n, label))


def test_vectors_that_take_no_part(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(3) for c in ("v", "n_links", "least", "times", "d", "component_id")})
    got = {x.vec_id: tuple(x)[1:] for x in ed.link(df).collect()}
    assert got[7] == (1, 7, True) and got[8] == (1, 7, False) and got[None] == (0, None, True)
    assert all(got[k] == (0, k, True) for k in (1, 2, 3, 4, 5, 6, 9))
    assert ed.link(df.limit(0)).count() == 0
    assert ed.link(df.where("vec_id = 1")).count() == 1


def test_lengths_and_extreme_numbers(spark):
    rng = np.random.default_rng(6)
    rows = []
    for d, scale in ((8, 1e-60), (8, 1e300), (5, 1.0), (3, 1e-300)):
        base = rng.normal(size=(40, d))
        rows += [(len(rows) + k, (scale * x).tolist()) for k, x in enumerate(np.concatenate([base, base[:20] * 0.5, base[:10] + 1e-3 * rng.normal(size=(10, d))]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in ed.link(df).collect()}
    for d in (8, 5, 3):
        own = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if len(v) == d]
        n, label = brute([i for i, _ in own], np.stack([v for _, v in own]), 0.9)
        assert {i: got[i] for i, _ in own} == {i: (int(a), int(b)) for (i, _), a, b in zip(own, n, label)}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    names = ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, op9_embedding_dedup(spark, sf).select(*names).collect())) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({OP9_SQL})").fetchall())


def test_shuffle_is_small_beside_the_vectors():
    """Bytes that a vector's keys take, as sent to tables (64 dimensions, 10,000 vectors): ids, keys and codes."""
    rng = np.random.default_rng(8)
    sample = rng.normal(size=(4096, 64))
    plan = ed.measured_plan(sample / np.linalg.norm(sample, axis=1, keepdims=True), 10_000, 0.9, 0.995, 5)
    assert plan.tables * (4 + 4 + 8 + 16 + 4) < 4 * 64 * 8
