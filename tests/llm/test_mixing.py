import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from framesift.llm import mixing
from framesift.llm.queries import QUALITY, TARGETS, op2_mixing


def test_totals_match_the_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = op2_mixing(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    p = rows[[f"p_{d}" for d in sorted(TARGETS)]].to_numpy()
    assert len(rows) == 1000 and np.allclose(p.sum(1), 1) and (rows.rate >= 0).all()
    totals = (p * (rows.rate * rows.n_tokens).to_numpy()[:, None]).sum(0) / rows.n_tokens.sum()
    assert np.allclose(totals, [TARGETS[d] for d in sorted(TARGETS)], atol=1e-6)
    assert abs(rows.copies.mean() - rows.rate.mean()) < 0.05 and ((rows.copies - rows.rate).abs() < 1).all()
    known = rows[rows.doc_id.isin(labels.index)]
    poor = labels.loc[known.doc_id].quality.to_numpy() == 0
    assert ((known.p_poor.to_numpy() > 0.5) == poor).mean() > 0.95


def nnls(a, b):
    """Non-negative least squares by Lawson and Hanson's active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while True:
        gradient = a.T @ (b - a @ x)
        gradient[free] = -1
        if gradient.max() < 1e-13:
            return x
        free[gradient.argmax()] = True
        while True:
            z = np.zeros(len(x))
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 0).all():
                x = z
                break
            bad = free & (z <= 0)
            x = x + min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300)) * (z - x)
            free &= x > 1e-14
            x[~free] = 0


def as_cells(spark, p, t):
    return spark.createDataFrame([(*map(float, x), float(y)) for x, y in zip(p, t)], ", ".join(f"p{k} double" for k in range(p.shape[1])) + ", tokens double")


def whitened(p, t):
    """A root of the weights of the missed totals: the inverse of the Gram matrix, with the fit's ridge."""
    gram = (p * (t / t.sum())[:, None]).T @ p
    return np.linalg.cholesky(np.linalg.inv(gram + 1e-6 * np.trace(gram) * np.eye(p.shape[1]))).T


def test_fit_equals_an_independent_solver(spark):
    """What the totals come to is the same for every solution. The last targets can't be met: half of each token is of
    the second domain at least."""
    rng = np.random.default_rng(0)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 300), rng.integers(1, 50, 300).astype(float)
    mixed = np.stack([0.5 * p[:, 0], 0.5 + 0.5 * p[:, 1], 0.5 * p[:, 2]], 1)
    for p, goal, near in ((p, [0.7, 0.25, 0.05], 1e-6), (mixed, [0.8, 0.15, 0.05], 2e-3)):
        goal, a, root = np.array(goal), (p * t[:, None] / t.sum()).T, whitened(p, t)
        want = a @ nnls(root @ a, root @ goal)
        got = mixing.fit(as_cells(spark, p, t), goal).toPandas()
        totals = (got.r * got.tokens).to_numpy() @ got[["p0", "p1", "p2"]].to_numpy() / t.sum()
        assert (got.r >= 0).all() and np.allclose(totals, want, atol=near)
        missed = [root @ (x - goal) for x in (totals, want)]
        assert missed[0] @ missed[0] <= 1.005 * missed[1] @ missed[1] + 1e-9
    assert np.abs(want - goal).max() > 0.1


def test_rates_are_those_of_projected_steps(spark):
    """As a plain loop over single rates: each step is projected before the next."""
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.2, 0.2], 50), rng.integers(1, 50, 50).astype(float)
    goal, w, r = np.array([0.95, 0.02]), t / t.sum(), np.ones(50)
    ridge = 1e-6 * np.trace((p * w[:, None]).T @ p) * np.eye(2)
    free = np.ones(50, bool)
    for _ in range(2):
        weight = np.linalg.inv((p * (w * free)[:, None]).T @ p + ridge)
        error = (r * w) @ p - goal
        r = np.maximum(0, r - p @ weight @ error)
        free = r > 0
    got = mixing.fit(as_cells(spark, p, t), goal, settings=mixing.Settings(steps=2, replayed=1)).toPandas().sort_values(["p0", "tokens"])
    assert np.allclose(got.r.to_numpy(), r[np.lexsort((t, p[:, 0]))], atol=1e-6) and (r == 0).any()


def test_edges(spark):
    rows = [(k, ("fine words in here and there " * 3 + str(k)) if k % 2 else "### !!! $$$ %%% " * 3) for k in range(60)]
    rows += [(100, None), (101, ""), (3, rows[3][1]), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("rate", "r", "p0", "tokens", "_cell", "_rates", "domain", "id", "p_good")})
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(41, None, None), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix_to_targets(docs, labels, QUALITY, {"good": 0.9, "poor": 0.1, "toxic": 0.5}).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert set(got[0].asDict()) == {"doc_id", "text", "rate", "r", "p0", "tokens", "_cell", "_rates", "domain", "id", "p_good", "p_poor", "p_toxic", "n_tokens", "copies"}
    assert by[1]._cell == by[1].tokens == by[1].id == "clash"
    assert by[1].p_good > 0.9 > 0.1 > by[2].p_good and by[1].p_toxic == 0
    assert by[1].rate > 1 > by[2].rate and by[100].n_tokens == 0
    total = sum(x.rate * x.n_tokens * x.p_good for x in got)
    assert abs(total / sum(x.n_tokens for x in got) - 0.9) < 1e-6  # toxic drops out, the rest is 0.9 and 0.1
    kept = mixing.mix_to_targets(docs, labels, QUALITY, {"good": 0.4, "poor": 0.6}, whole="good").collect()
    assert all(x.copies >= 1 for x in kept if x.p_good >= 0.5)
    long = spark.createDataFrame([(102, "a very long text " * 100_000), (1, rows[1][1]), (2, rows[2][1])], "doc_id long, text string")
    assert sorted(x.n_tokens for x in mixing.mix_to_targets(long, labels, QUALITY, {"good": 0.9, "poor": 0.1}).collect()) == [12, 19, 400_000]
    none = mixing.mix_to_targets(docs, labels.limit(0), QUALITY, {"good": 1.0}).collect()
    assert [(x.rate, x.copies) for x in none] == [(1.0, 1)] * len(rows)
    assert mixing.mix_to_targets(docs.limit(0), labels, QUALITY, {"good": 1.0}).count() == 0


def kept_shares(spark, p, t, goal, held):
    """Rates, probabilities and expected shares of what is kept."""
    p = np.array(p)
    rows = mixing.fit(as_cells(spark, p, t), np.array(goal), True, held).toPandas()
    p = rows[[f"p{k}" for k in range(p.shape[1])]].to_numpy()
    weight = rows.r.to_numpy() * rows.tokens.to_numpy()
    return rows.r.to_numpy(), p, weight @ p / weight.sum()


def test_kept_tokens_meet_the_targets(spark):
    r, p, share = kept_shares(spark, [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]], [70, 30, 1e-6], [0.9, 0.1], 0)
    assert abs(share[0] - 0.9) < 1e-6 and (r[p[:, 0] >= 0.5] == 1).all() and abs(r[p[:, 0] == 0][0] - 0.7 / 9 / 0.3) < 1e-5
    r, _, _ = kept_shares(spark, [[1.0, 0.0], [0.0, 1.0]], [97, 3], [0.9, 0.1], 0)
    assert (r == 1).all()  # too few poor tokens: nothing is thinned
    r, p, share = kept_shares(spark, np.random.default_rng(1).dirichlet([0.3, 0.3, 0.3], 400), np.ones(400), [0.5, 0.3, 0.2], 0)
    assert np.allclose(share, [0.5, 0.3, 0.2], atol=1e-6) and (r[p[:, 0] >= 0.5] == 1).all() and ((r >= 0) & (r <= 1)).all()


def test_stage_output_has_the_target_shares(spark, monkeypatch):
    sf, mixed = "/root/testdata/sf0.1", []
    plain = mixing.mix_to_targets
    monkeypatch.setattr(mixing, "mix_to_targets", lambda *a, **b: mixed.append(plain(*a, **b).persist()) or mixed[0])  # computed once
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [x.doc_id for x in corpus_pipeline.mix(spark, docs, sf).select("doc_id").collect()]
    rows = mixed[0].drop("text").toPandas().set_index("doc_id")
    assert len(set(kept)) == len(kept) and set(rows[rows.p_good >= 0.5].index) <= set(kept)
    rows = rows.loc[kept]
    assert abs((rows.n_tokens * rows.p_good).sum() / rows.n_tokens.sum() - corpus_pipeline.TARGETS["good"]) < 0.005


def test_soft_posteriors_keep_likely_documents_whole(spark, monkeypatch):
    likely = [0.02, 0.3, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9, 1.0]  # P(good) by the logarithm of the length
    p = F.element_at(F.array(*map(F.lit, likely)), mixing._bucket(0) + 1)
    monkeypatch.setattr(mixing, "train", lambda *a: mixing.Classifier(["good", "poor"], [], [], []))
    monkeypatch.setattr(mixing, "_posterior", lambda model: [p, 1 - p])
    rows = [(f"{b}-{i}", " ".join(["w"] * 2**b)) for b in range(9) for i in range(2 ** (8 - b))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for good in (0.9, 0.7):
        got = mixing.mix_to_targets(docs, docs.selectExpr("doc_id", "1 AS quality"), "quality", {"good": good, "poor": 1 - good}, whole="good").collect()
        assert all(x.rate == 1 and x.copies == 1 for x in got if x.p_good >= 0.5)
        assert all(0 <= x.rate <= 1 for x in got)
        share = sum(x.rate * x.n_tokens * x.p_good for x in got) / sum(x.rate * x.n_tokens for x in got)
        if good == 0.7:
            assert abs(share - 0.7) < 1e-6
        else:  # out of reach while likely documents stay: all others go
            assert all(x.rate == 0 for x in got if x.p_good < 0.5)
