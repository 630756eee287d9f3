import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framesift.operators import manifest, merge, partition, progress, rerank, shots, topk, validate


def test_top_unique_replaces_a_unit_by_a_better_row(spark):
    rows = [("t", "a", 1.0, 10), ("t", "b", 2.0, 20), ("t", "c", 1.5, 30), ("t", "a", 3.0, 40), ("t", "b", 1.0, 50)]
    out = topk.top_unique(spark.createDataFrame(rows, "task_id string, shot_uid string, score double, source_index long"), 2).orderBy("rank").collect()
    assert [(x.shot_uid, x.source_index, x.rank, x.embedding_score) for x in out] == [("a", 40, 1, 3.0), ("b", 20, 2, 2.0)]
    with pytest.raises(ValueError):
        topk.top_unique(spark.createDataFrame(rows, "task_id string, shot_uid string, score double, source_index long"), 0)


def test_retrieve_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (300, 8)).astype(float)  # many ties
    units = rng.integers(0, 40, 300)
    queries = rng.integers(-2, 3, (7, 8)).astype(float)
    frames = spark.createDataFrame([(i, f"u{u}", v.tolist()) for i, (u, v) in enumerate(zip(units, vectors))], "source_index long, shot_uid string, embedding array<float>").repartition(5)
    tasks = spark.createDataFrame([(f"q{k}", q.tolist()) for k, q in enumerate(queries)], "task_id string, query array<double>")
    want = []
    for k, q in enumerate(queries):
        best = {}
        for i, u in enumerate(units):
            best[u] = min(best.get(u, (9e9, 0)), (-float(vectors[i] @ q), i))
        want += [(f"q{k}", f"u{u}", i, -s, r + 1) for r, (s, i, u) in enumerate(sorted((s, i, u) for u, (s, i) in best.items())[:6])]
    for kept in (400_000, 12):  # all queries at once, and two at a time
        monkeypatch.setattr(topk, "KEPT_ROWS", kept)
        got = topk.retrieve(tasks, frames, 6).select("task_id", "shot_uid", "source_index", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.retrieve(tasks.limit(0), frames, 6).count() == 0
    assert topk.retrieve(tasks, frames.limit(0), 6).count() == 0


def test_top_k_plan_prunes_before_the_shuffle(spark):
    from framesift.session import tune

    tune(spark)
    rows = spark.createDataFrame([("t", "a", 1.0, 1)], "task_id string, shot_uid string, score double, source_index long")
    plan = topk.top_unique(rows, 3000)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "partial_min" in plan


def simulate(task, candidates, score, fine_top_k, most):
    """The second stage in plain Python, from its description: lists, sorts, sets."""
    seen, unique = set(), []
    for c in sorted(candidates, key=lambda c: c["rank"]):
        if (c["video"], c["shot"]) not in seen:
            seen.add((c["video"], c["shot"]))
            unique.append(c)

    def coarse_times(s, e):
        n = e - s
        if n <= 2000:
            return [s + n // 2]
        if n <= 5000:
            return [s + n // 3, s + 2 * n // 3]
        return list(range(s + 500, e, 1000))

    order = lambda r: (-r["score"], -r["emb"])
    coarse = []
    for c in sorted(unique, key=lambda c: (c["video"], c["start"], c["shot"])):
        if c["readable"]:
            coarse += [dict(video=c["video"], shot=c["shot"], start=c["start"], end=c["end"], at=t, emb=c["emb"], fine=0, score=score(task, c["shot"], t)) for t in coarse_times(c["start"], c["end"])]
    coarse.sort(key=order)
    first = {}
    for r in coarse:
        first.setdefault((r["video"], r["shot"]), r)
    known, fine = {(r["video"], r["shot"], r["at"]) for r in coarse}, []
    for r in sorted(sorted(first.values(), key=order)[:fine_top_k], key=lambda r: (r["video"], r["at"])):
        for t in sorted({r["at"], *range(r["at"] - 750, r["at"] + 751, 125)}):
            if max(r["start"], r["at"] - 750) <= t <= min(r["end"], r["at"] + 750) and (r["video"], r["shot"], t) not in known:
                known.add((r["video"], r["shot"], t))
                fine.append(r | dict(at=t, fine=1, score=score(task, r["shot"], t)))
    every = sorted(coarse + fine, key=lambda r: (-r["score"], -r["fine"], -r["emb"]))
    videos, out = set(), []
    for video, at in [(r["video"], r["at"]) for r in every] + [(c["video"], 0) for c in unique]:
        if video not in videos and len(out) < most:
            videos.add(video)
            out.append((task, len(out) + 1, video, at))
    return out


def test_rerank_equals_a_plain_simulation(spark):
    rng = random.Random(5)

    def score(task, shot, at):
        return ((task * 31 + shot * 17 + at * 7) % 13) / 13  # many ties

    shots_table, candidates, want = {}, [], []
    for shot in range(60):
        start = shot * 4000
        shots_table[shot] = (f"v{shot // 4:02d}", start, start + rng.choice([900, 2600, 4000, 7300]))
    for task in range(6):
        mine = []
        for rank in range(1, 41):
            shot = rng.randrange(60)
            video, start, end = shots_table[shot]
            mine.append(dict(rank=rank, video=video, shot=shot, start=start, end=end, emb=round(1 - rank / 8) / 5, readable=video not in ("v03", "v07")))
        candidates += [(f"T{task}", c["video"], c["shot"], c["rank"], c["emb"]) for c in mine]
        want += [(f"T{t}", r, v, a) for t, r, v, a in simulate(task, mine, score, 4, 16)]
    df = spark.createDataFrame(candidates, "task_id string, video_id string, shot_id long, rank long, score double")
    null = F.lit(None)
    df = df.withColumns({"embedding_score": null.cast("double"), "frame_ms": null.cast("long"), "shot_start_ms": null.cast("long"), "shot_end_ms": null.cast("long")})
    known = spark.createDataFrame([(v, k, a, b) for k, (v, a, b) in shots_table.items()], "video_id string, shot_id long, start_ms long, end_ms long")
    readable = known.select("video_id").distinct().where("video_id NOT IN ('v03', 'v07')")

    def scorer(frames):
        return frames.withColumn("reranker_score", ((F.substring("task_id", 2, 3).cast("long") * 31 + F.col("shot_id") * 17 + F.col("frame_ms") * 7) % 13) / F.lit(13.0))

    stage = rerank.Rerank(df, known, scorer, readable, 40, 4, 750, 8.0, 1.0, 16)
    got = [tuple(x) for x in stage.selected.select("task_id", "rank", "video_id", "frame_ms").collect()]
    assert sorted(got) == sorted(want)
    assert any(x.stage == 1 for x in stage.selected.collect())
    stats = {x.task_id: x for x in stage.stats.collect()}
    assert len(stats) == 6 and all(x.fine_centers == 4 and x.coarse_frames > 0 for x in stats.values())
    with pytest.raises(ValueError):
        rerank.unique_shots(df, 0)
    tasks = spark.createDataFrame([("T0",), ("T9",)], "task_id string")
    with pytest.raises(PySparkException, match="no candidates for task T9"):
        rerank.require_candidates(tasks, df).collect()


def test_normalise_ranges(spark):
    rows = [("a", 25.0, 100, [[0.5, 10.5], [90.0, 20.0], [50.0, 500.0], [-4.0, 1.5]]), ("b", 0.0, 50, []), ("c", 10.0, 1, None)]
    out = shots.normalise_ranges(shots.video_meta(spark.createDataFrame(rows, "video_id string, fps double, frame_count long, ranges array<array<double>>")))
    got = [(x.video_id, x.shot_id, x.start_frame, x.end_frame, x.start_ms, x.end_ms) for x in out.orderBy("video_id", "shot_id").collect()]
    assert got == [("a", 0, 0, 10, 0, 400), ("a", 1, 20, 90, 800, 3600), ("a", 2, 50, 99, 2000, 3960), ("a", 3, 0, 2, 0, 80), ("b", 0, 0, 49, 0, 1960), ("c", 0, 0, 0, 0, 0)]
    bad = spark.createDataFrame([("a", 25.0, 10, [[1.0]])], "video_id string, fps double, frame_count long, ranges array<array<double>>")
    with pytest.raises(PySparkException, match="two frames"):
        shots.normalise_ranges(bad).collect()
    with pytest.raises(PySparkException, match="no frames"):
        shots.video_meta(spark.createDataFrame([("a", 25.0, 0)], "video_id string, fps double, frame_count long")).collect()


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 13).alias("g")).repartition(7)
    got = manifest.number_rows(df, ["k"], "n").collect()
    assert sorted((x.k, x.n) for x in got) == [(k, k) for k in range(1000)]
    got = sorted((x.n, x.g, x.k) for x in manifest.number_rows(df, ["g", "k"], "n", group="g").collect())
    assert [x[0] for x in got] == list(range(1000)) and [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_numbering_loses_no_row(spark, tmp_path):
    """Wide rows, so that the exchange of the rows is split otherwise than that of their counts; eight files."""
    wide = spark.range(60_000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(40)).alias("k"), F.repeat(F.sha2(F.col("id").cast("string").cast("binary"), 256), 8).alias("text"))
    wide = wide.withColumn("k", F.when(F.col("k") > 0, F.col("k")))  # nulls too
    wide.repartition(8).write.parquet(str(tmp_path / "wide"))
    manifest.number_rows(spark.read.parquet(str(tmp_path / "wide")), ["k", "id"], "n").write.parquet(str(tmp_path / "out"))
    got = [(x.n, x.k or 0, x.id) for x in spark.read.parquet(str(tmp_path / "out")).select("n", "k", "id").orderBy("n").collect()]
    assert [n for n, _, _ in got] == list(range(60_000)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
    assert manifest.number_rows(wide.limit(0), ["k", "id"], "n").count() == 0


def test_all_pairs_are_for_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(topk, "FEW_TASKS", 2)
    monkeypatch.setattr(topk, "DRIVER_BYTES", 64)
    tasks = spark.range(3).select(F.concat(F.lit("t"), "id").alias("task_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("query"))
    frames = spark.range(9).select(F.col("id").alias("source_index"), F.col("id").cast("string").alias("shot_uid"), F.array(*(F.lit(1.0),) * 3).alias("embedding"))
    with pytest.raises(ValueError, match="too many tasks"):
        topk.score_pairs(tasks, frames)
    with pytest.raises(ValueError, match="keep"):
        topk.retrieve(tasks, frames, 2)
    assert topk.retrieve(tasks, frames, 2, keep=lambda df, at: spark.createDataFrame(df.collect(), df.schema)).count() == 6


def test_partitions(spark):
    df = spark.range(17)
    for parts in (1, 3, 20):
        sizes = [partition.take_partition(df, i, parts, "id").count() for i in range(parts)]
        wanted = spark.range(parts).select(partition.partition_size(F.lit(17).cast("long"), F.col("id"), F.lit(parts).cast("long")).alias("n")).collect()
        assert sizes == [x.n for x in wanted] and sum(sizes) == 17
    with pytest.raises(ValueError):
        partition.take_partition(df, 3, 3, "id")


def test_merge(spark):
    tasks = spark.createDataFrame([("T1", 0), ("T2", 1), ("T3", 2)], "task_id string, task_pos long")
    part = lambda *ids: spark.createDataFrame([(i, i.lower()) for i in ids], "task_id string, x string")
    assert [r.task_id for r in merge.merge([part("T1", "T3"), part("T2")], tasks).collect()] == ["T1", "T2", "T3"]
    for parts, what in (([part("T1"), part("T1", "T2", "T3")], "more than one"), ([part("T1", "T2")], "missing tasks: T3"), ([part("T1", "T2", "T3", "T4")], "unexpected tasks: T4"), ([], "nothing")):
        with pytest.raises(ValueError, match=what):
            merge.merge(parts, tasks)


def test_rolling_rate_and_progress_line(spark):
    samples = spark.createDataFrame([("r", 20.0, 200), ("r", 30.0, 300), ("r", 40.0, 500)], "run string, at double, completed long")
    rated = progress.rolling_rate(progress.with_start(samples, 10.0, 100), 2).withColumn("total", F.lit(1000).cast("long"))
    rows = progress.snapshot(rated).orderBy("at").collect()
    assert [x.rate for x in rows] == [None, 10.0, 10.0, 15.0]
    assert rows[1].eta_seconds == 80.0 and rows[3].eta_seconds == 500 / 15
    short = spark.createDataFrame([("r", 5.0, 25)], "run string, at double, completed long")
    line = progress.snapshot(progress.rolling_rate(progress.with_start(short, 0.0, 0), 8).withColumn("total", F.lit(100).cast("long"))).orderBy("at").collect()[1].line
    assert line == "25/100 frames (25.00%) rate=5.00 frames/s ETA=15s elapsed=5s"
    back = spark.createDataFrame([("r", 1.0, 5), ("r", 2.0, 4)], "run string, at double, completed long")
    with pytest.raises(PySparkException, match="cannot go back"):
        progress.rolling_rate(back, 8).collect()


def test_submission_faults(spark):
    tasks = spark.createDataFrame([("T1", 0), ("T2", 1)], "task_id string, task_pos long")
    videos = spark.createDataFrame([("a",), ("b",)], "video_id string")

    def faults(text):
        return sorted((x.task_id, x.fault) for x in validate.submission_faults(spark, text, tasks, videos).collect())

    good = '{"predictions": [{"task_id": "T1", "results": [{"rank": 1, "video_id": "a", "frame_ms": 0}]}, {"task_id": "T2", "results": []}]}'
    assert faults(good) == []
    assert faults(good.replace('"frame_ms": 0', '"frame_ms": true')) == [("T1", "frame_ms is not an integer")]
    assert faults(good.replace('"frame_ms": 0', '"frame_ms": 1.0')) == [("T1", "frame_ms is not an integer")]
    assert faults(good.replace('"frame_ms": 0', '"frame_ms": -1')) == [("T1", "frame_ms is negative")]
    assert faults(good.replace('"a"', '"z"')) == [("T1", "unknown video_id")]
    assert faults(good.replace('"a"', "7")) == [("T1", "invalid video_id")]
    assert faults(good.replace('"rank": 1', '"rank": 2')) == [("T1", "ranks are not 1 to n")]
    assert faults(good.replace('"T2"', '"T3"')) == [("T2", "task ids or their order differ")]
    assert faults(good.replace('[]', '{}')) == [("T2", "results must be a list")]
    assert faults('{"predictions": 3}') == [(None, "predictions must be a list")]
    assert (None, "predictions must be the only key") in faults(good[:-1] + ', "x": 1}')


def test_task_faults_and_ranges(spark):
    rows = [("", "x"), (None, "x"), ("a", "x"), ("a", "y"), ("b", ""), ("c", None), ("d", "z")]
    found = sorted((x.task_id or "", x.fault) for x in validate.task_faults(spark.createDataFrame(rows, "task_id string, description string")).collect())
    assert found == [("", "task without task_id")] * 2 + [("a", "duplicate task_id"), ("b", "task without description"), ("c", "task without description")]
    validate.check_ranges(dimension=64)
    for bad in ({"dimension": 63}, {"partitions": 0}, {"index": 1}, {"batch_size": 0}, {"shard_size": 0}, {"decoder": "x"}):
        with pytest.raises(ValueError):
            validate.check_ranges(**bad)
    corpora = spark.createDataFrame([("a", True, 64), ("b", False, 128)], "corpus string, complete boolean, dimension long")
    assert validate.same_dimension(corpora).count() == 2
