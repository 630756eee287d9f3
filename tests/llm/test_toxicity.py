import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from framesift.llm import toxicity
from framesift.llm.langid import fold
from framesift.llm.queries import op8_toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows)
    held = [(labels[x.doc_id], x.predicted) for x in rows if x.held_out and x.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert np.mean([b for a, b in held if a == 1]) > 0.8


def _index(dense, labels, ids, block, k):
    rows, terms = np.nonzero(dense)
    return toxicity.Index(rows, terms, dense[rows, terms], dense.shape[1], labels, ids, block, k)


def test_block_max_search_equals_brute_force():
    rng = np.random.default_rng(5)
    dense = rng.random((500, 60)) * (rng.random((500, 60)) < 0.1)
    dense[50:80] = dense[0]  # ties
    dense = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    ids = rng.permutation(500)
    index = _index(dense, rng.integers(0, 2, 500).astype(float), ids, 16, 9)
    for _ in range(60):
        q = rng.random(60) * (rng.random(60) < 0.15)
        terms = np.flatnonzero(q)
        got, cos = index.nearest(terms, q[terms])
        every = np.round(dense @ q, 12)
        want = [i for i in np.lexsort((ids, -every)) if every[i] > 0][:9]
        assert got.tolist() == want and np.allclose(cos, every[want])


def _words(text):
    return Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()))


def test_query_equals_brute_force(spark):
    """Terms, IDF, cosines, the nearest, votes and scores of all documents, by dictionaries."""
    sf, settings = "/root/testdata/sf0.01", toxicity.Settings()
    docs, table = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = table.where(fold("doc_id", 5) != 0)
    model = toxicity.fit(docs, known, settings)
    text = {x.doc_id: x.text for x in docs.collect()}
    part = {x.doc_id: (x.toxic, x.apart) for x in known.select("doc_id", "toxic", (F.pmod(F.xxhash64(F.lit(37), "doc_id"), F.lit(4)) == 0).alias("apart")).collect() if x.doc_id in text}
    learn = {i: y for i, (y, apart) in part.items() if not apart}
    assert len(learn) < settings.sample
    n, df = Counter(learn.values()), [Counter(), Counter()]
    for i, y in learn.items():
        df[y].update(_words(text[i]).keys())
    idf = {}
    for w in df[0] | df[1]:
        a, b = df[1][w], df[0][w]
        p = (a + b) / sum(n.values())
        z = (a / n[1] - b / n[0]) / math.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-12)
        if a + b >= 5 and abs(z) >= 3:
            idf[w] = math.log((sum(n.values()) + 1) / (a + b + 1)) + 1e-3
    assert len(idf) == len(model.known)

    def unit(i):
        v = {w: (1 + math.log(c)) * idf[w] for w, c in _words(text[i]).items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / size for w, x in v.items()}

    examples = {i: unit(i) for i in learn}

    def nearest(i):
        q = unit(i)
        cos = [(-round(sum(x * e.get(w, 0) for w, x in q.items()), 12), j) for j, e in examples.items()]
        return [(j, -c) for c, j in sorted(cos)[:15] if c < 0]

    def vote(i):
        found = nearest(i)
        return sum(c * c * learn[j] for j, c in found) / sum(c * c for _, c in found) if found else -1

    rest = [i for i, (_, apart) in part.items() if apart]
    steps, values = toxicity.isotonic(np.array([vote(i) for i in rest]), np.array([float(part[i][0]) for i in rest]), np.mean([part[i][0] for i in rest]))
    for row in toxicity.score(docs, model, evidence=15).collect():
        want = nearest(row.doc_id)
        assert np.allclose([x.cosine for x in row.evidence], [c for _, c in want])
        assert [x.doc_id for x in row.evidence] == [j for j, _ in want]
        assert np.isclose(row.score, np.interp(vote(row.doc_id), steps, values), atol=1e-6)


def test_a_long_text_in_stretches(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(f"w{k}" for k in rng.integers(0, 300, 20_000)).encode()
    data, ends = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = [x.tolist() for x in toxicity.terms_of(data, ends)]
    monkeypatch.setattr(toxicity, "SLICE", 1000)
    assert [x.tolist() for x in toxicity.terms_of(data, ends)] == whole
    known = np.sort(np.array(whole[1][:40], np.uint64))
    assert toxicity.terms_of(data, ends, known)[2].sum() == sum(c for t, c in zip(whole[1], whole[2]) if t in set(known.tolist()))


def test_edges(spark):
    rows = [(k, f"you stupid clown {k}" if k % 3 == 0 else f"a fine day in the garden {k}", int(k % 3 == 0)) for k in range(90)]
    labelled = spark.createDataFrame([*rows, (91, None, 0), (92, "x", None)], "doc_id long, text string, toxic int")
    settings = toxicity.Settings(sample=25, examples=10, calibration=200, significance=2, block=4, k=5, least_rows=2)
    m = toxicity.fit(labelled, labelled, settings)
    df = spark.createDataFrame([(1, "what a stupid CLOWN", "x"), (2, "the garden", "x"), (3, None, "x"), (4, "", "x"), (5, "stupid clown " * 5000, "x"), (5, "stupid clown", "x")], "doc_id long, text string, score string")
    got = toxicity.score(df, m).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == 6 and by[1].score > 0.5 > by[2].score and by[5].score > 0.5
    assert by[3].score == by[4].score < 0.5 and by[3].evidence == []
    assert by[1].evidence[0].toxic == 1
    none = toxicity.fit(labelled, labelled.where("toxic = 0"), settings)
    assert [x.score for x in toxicity.score(df, none).collect()] == [0.0] * 6
    every = toxicity.fit(labelled, labelled.where("toxic = 1"), settings)
    assert [x.score for x in toxicity.score(df, every).collect()] == [1.0] * 6
    assert [x.score for x in toxicity.score(df, toxicity.fit(labelled, labelled.limit(0), settings)).collect()] == [0.0] * 6
    assert toxicity.score(df.limit(0), m).count() == 0
    wide = df.withColumns({"evidence": F.lit(1), "id": F.lit(2), "y": F.lit(3), "part": F.lit(4), "term": F.lit(5)})
    kept = toxicity.score_with(wide, m)
    assert kept.columns == ["doc_id", "text", "id", "y", "part", "term", "score", "evidence"]
    assert {(x.doc_id, x.score) for x in kept.collect()} == {(x.doc_id, x.score) for x in got}
