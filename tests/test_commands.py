import functools
import json
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framesift import models, schemas
from framesift.functions import pixels, sampling
from framesift.plans import commands
from framesift.sources import control, corpus, sinks, tables, videos
from framesift.streaming import embed as streaming


@pytest.fixture
def world(tmp_path):
    for name in ("00001", "00002", "00003"):
        folder = tmp_path / "V3C1" / "videos" / name
        folder.mkdir(parents=True)
        (folder / f"{name}.mp4").write_bytes(b"x")
    (tmp_path / "tasks.jsonl").write_text('{"task_id": "T1", "description": "a cat"}\n\n{"task_id": 2, "description": "a dog", "more": 1}\n{"task_id": "T3", "description": "x"}\n')
    return tmp_path


def test_from_videos_to_submission(spark, world):
    root, out = str(world), str(world / "out")
    made = commands.make_shots(spark, [f"{root}/V3C1"], f"{out}/shots", models.GridDetector)
    assert made == {"completed": 3, "skipped": 0, "failed": 0, "exit_code": 0}
    assert commands.make_shots(spark, [f"{root}/V3C1"], f"{out}/shots", models.GridDetector)["skipped"] == 3
    assert commands.make_shots(spark, [f"{root}/V3C1"], f"{out}/shots", models.GridDetector, dry_run=2)["dry_run"] == ["v3c1_00001", "v3c1_00002"]
    stats = commands.make_manifest(spark, f"{out}/shots", root, f"{out}/manifest", strict=True)
    frames = spark.read.parquet(f"{out}/manifest")
    assert stats["video_count"] == 3 and stats["missing_video_count"] == 0 and stats["frame_count"] == frames.count()
    assert sorted(x.source_index for x in frames.collect()) == list(range(stats["frame_count"]))

    embedder = lambda: models.HashEmbedder(64)
    for k in range(2):
        state = commands.embed_corpus(spark, f"{out}/manifest", f"{out}/corpus{k}", [models.HashReader], embedder, 64, 8, k, 2, chunk=5)
        assert state["complete"] and state["failed"] == 0 and len(state["chunks"]) > 1
    again = commands.embed_corpus(spark, f"{out}/manifest", f"{out}/corpus0", [models.HashReader], embedder, 64, 8, 0, 2, chunk=5)
    assert again["embedded"] == control.read(spark, f"{out}/corpus0/_corpus.json")["embedded"]
    with pytest.raises(ValueError, match="shard_size"):
        commands.embed_corpus(spark, f"{out}/manifest", f"{out}/corpus0", [models.HashReader], embedder, 64, 9, 0, 2)
    both = [f"{out}/corpus0", f"{out}/corpus1"]
    assert corpus.read_corpora(spark, both).count() == stats["frame_count"]

    tasks = f"{root}/tasks.jsonl"
    parts = []
    for k in range(2):
        for again in (False, True):
            assert commands.retrieve(spark, tasks, both, f"{out}/found{k}", embedder, 50, k, 2, reuse=True)["reused"] is again
        parts.append(f"{out}/found{k}")
    assert commands.merge_candidates(spark, parts, tasks, f"{out}/found")["tasks"] == 3
    found = tables.load_candidates(spark, f"{out}/found")
    assert found.where("rank = 1").count() == 3

    subs = []
    for k in range(2):
        done = commands.rerank_tasks(spark, tasks, [f"{out}/found"], f"{out}/shots", root, f"{out}/part{k}", [models.HashReader], models.HashScorer, fine_top_k=3, index=k, parts=2)
        assert done["tasks"] == 2 - k
        subs.append(f"{out}/part{k}/submission.json")
    before = control.read(spark, subs[0])
    commands.rerank_tasks(spark, tasks, [f"{out}/found"], f"{out}/shots", root, f"{out}/part0", [models.HashReader], models.HashScorer, fine_top_k=3, index=0, parts=2)
    assert control.read(spark, subs[0]) == before
    assert commands.merge_submissions(spark, subs, tasks, f"{out}/final")["tasks"] == 3
    value = json.loads((world / "out/final/submission.json").read_text())
    assert [p["task_id"] for p in value["predictions"]] == ["T1", "2", "T3"]
    assert all(len(p["results"]) == 3 for p in value["predictions"])
    with zipfile.ZipFile(world / "out/final/submission.zip") as z:
        assert json.loads(z.read("submission.json")) == value
    assert commands.validate_submission(spark, f"{out}/final/submission.json", tasks, f"{out}/shots") == {"tasks": 3, "results": 9}
    value["predictions"].reverse()
    (world / "bad.json").write_text(json.dumps(value))
    with pytest.raises(ValueError, match="order"):
        commands.validate_submission(spark, f"{root}/bad.json", tasks)


def test_state_of_another_plugin_or_input_is_refused(spark, world):
    root, out = str(world), str(world / "out")
    commands.make_shots(spark, [f"{root}/V3C1"], f"{out}/shots", models.GridDetector)
    assert control.read(spark, f"{out}/shots/_provenance.json")["spark"] == spark.version
    with pytest.raises(ValueError, match="detector"):
        commands.make_shots(spark, [f"{root}/V3C1"], f"{out}/shots", functools.partial(models.GridDetector))
    commands.make_manifest(spark, f"{out}/shots", root, f"{out}/manifest")

    def embed(embedder=functools.partial(models.HashEmbedder, 64), reader=models.HashReader, **more):
        return commands.embed_corpus(spark, f"{out}/manifest", f"{out}/corpus", [reader], embedder, 64, 8, **more)

    assert embed()["complete"]
    for change, key in (({"embedder": functools.partial(models.HashEmbedder, 65)}, "embedder"), ({"reader": models.PaintReader}, "readers"), ({"side": 99}, "side"), ({"batch_size": 3}, "batch_size")):
        with pytest.raises(ValueError, match=key):
            embed(**change)
    commands.make_manifest(spark, f"{out}/shots", root, f"{out}/manifest", long_shot_fps=1.0)
    with pytest.raises(ValueError, match="manifest_sha256"):
        embed()

    tasks, mine = f"{root}/tasks.jsonl", functools.partial(models.HashEmbedder, 64)

    def find(embedder=mine, **more):
        return commands.retrieve(spark, tasks, [f"{out}/corpus"], f"{out}/found", embedder, 5, reuse=True, **more)["reused"]

    assert [find(), find(), find(instruction="find it"), find(instruction="find it"), find()] == [False, True, False, True, False]
    with pytest.raises(ValueError, match="embedded by"):
        find(functools.partial(models.HashEmbedder, 65))
    with open(tasks, "a") as f:
        f.write('{"task_id": "T4", "description": "more"}\n')
    assert find() is False and find() is True

    def rank(scorer=models.HashScorer, **more):
        return commands.rerank_tasks(spark, tasks, [f"{out}/found"], f"{out}/shots", root, f"{out}/ranked", [models.HashReader], scorer, fine_top_k=2, **more)

    assert rank()["tasks"] == 4 and rank()["tasks"] == 4
    for change, key in (({"scorer": functools.partial(models.HashScorer)}, "scorer"), ({"instruction": "x"}, "instruction"), ({"side": 9}, "side"), ({"chunk": 3}, "chunk")):
        with pytest.raises(ValueError, match=key):
            rank(**change)
    find(instruction="other words")
    with pytest.raises(ValueError, match="candidates_sha256"):
        rank()


def test_plugins_get_instructions_and_bounded_batches(spark):
    class Seen:
        plugin_name = "seen-1"

        def embed(self, items, instruction=""):
            return np.array([[len(items), len(instruction), 1.0]] * len(items))

        def score(self, query, images, instruction=""):
            return [len(images) + len(instruction) / 10] * len(images)

    items = spark.range(7, numPartitions=1).select("id", F.lit("x").alias("text"))
    rows = models.embed(items, "text", Seen, 3, instruction="four", batch_size=3).orderBy("id").collect()
    assert [round(x.embedding[0] / x.embedding[2]) for x in rows] == [3, 3, 3, 3, 3, 3, 1] and all(round(x.embedding[1] / x.embedding[2]) == 4 for x in rows)
    frames = items.select("id", F.lit("q").alias("description"), F.lit(b"i").alias("image"))
    assert sorted(x.reranker_score for x in models.score(frames, Seen, instruction="12345", chunk=3).collect()) == [1.5] + [3.5] * 6
    assert models.name_of(Seen) == "seen-1" and models.name_of(functools.partial(Seen, 1, k=2)) == "seen-1(1, k=2)"
    makers = [lambda n=n: n for n in (1, 2)] + [(lambda n: lambda: n)(n) for n in (1, 2)]
    assert len({models.name_of(f) for f in makers[2:]}) == 2 and models.name_of(makers[2]) == models.name_of((lambda n: lambda: n)(1))


def test_pixels_are_made_to_fit(spark):
    frames = spark.createDataFrame([("a.paint", 5), ("b", 6)], "video_path string, frame_ms long")
    rows = {x.video_path: x for x in models.read_frames(frames, [models.PaintReader, models.HashReader], 16).collect()}
    small = pixels.from_ppm(bytes(rows["a.paint"].image))
    assert small.shape == (12, 16, 3) and rows["a.paint"].decoder == "paint" and rows["b"].decoder == "hash"
    whole = models.PaintReader().read("a.paint", 5)
    assert (pixels.fit_within(whole, 0) == whole).all() and pixels.fit_within(whole, 64).shape == whole.shape
    assert (pixels.fit_within(np.full((40, 80, 3), 77, np.uint8), 13) == 77).all()
    means = whole[:, :, 1].astype(float).reshape(12, 4, 16, 4).mean((1, 3))
    assert np.abs(pixels.fit_within(whole, 16)[1:-1, 1:-1, 1] - means[1:-1, 1:-1]).max() < 2
    for w, h, side in ((1920, 1080, 512), (3, 1000, 100), (512, 512, 512), (7, 5, 0)):
        got = spark.range(1).select(sampling.fit_within(F.lit(w).cast("long"), F.lit(h).cast("long"), side).alias("s")).first().s if side else None
        assert not side or pixels.fit_size(w, h, side) == (got.width, got.height)


def test_readers_keep_few_files_open():
    class Handle:
        def __init__(self, path):
            self.path, self.closed = path, False

        def close(self):
            self.closed = True

    made = []
    files = models.OpenFiles(lambda p: made.append(Handle(p)) or made[-1], 2)
    for p in "aabacab":
        files.get(p)
    assert [h.path for h in made] == ["a", "b", "c", "b"] and [h.closed for h in made] == [False, True, True, False]
    files.close()
    assert all(h.closed for h in made)


def test_shot_manifest_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"video_id": "clip", "shots": [{"shot_id": i, "start_ms": a, "end_ms": b} for i, a, b in ((0, 0, 2000), (1, 2000, 5000), (2, 5000, 18000))]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"shots": []}))
    stats = commands.make_manifest(spark, str(tmp_path), str(tmp_path), str(tmp_path / "out"))
    assert (stats["video_count"], stats["shot_count"], stats["frame_count"], stats["missing_video_count"]) == (2, 3, 6, 2)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("source_index").collect()
    assert [x.frame_ms for x in rows] == [1000, 3000, 4000, 7000, 11000, 15000] and rows[0].shot_uid == "clip:0"
    assert sorted(x.video_id for x in tables.read_shot_manifests(spark, str(tmp_path)).collect()) == ["b", "clip"]
    with pytest.raises(PySparkException, match="video not found"):
        commands.make_manifest(spark, str(tmp_path), str(tmp_path), str(tmp_path / "out2"), strict=True)


def test_errors_have_a_table_of_their_own(spark, world):
    folder = world / "V3C1" / "videos" / "fail"
    folder.mkdir()
    (folder / "fail1.mp4").write_bytes(b"x")
    made = commands.make_shots(spark, [f"{world}/V3C1"], f"{world}/shots", models.GridDetector)
    assert made["failed"] == 1 and made["exit_code"] == 1
    log = tables.read_jsonl(spark, f"{world}/shots/failures", schemas.FAILURE).collect()
    assert [(x.video_id, x.error_type) for x in log] == [("v3c1_fail1", "ValueError")]
    frames = spark.createDataFrame([("a", 5), ("fail", 6)], "video_path string, frame_ms long")
    good, bad = sinks.split_failures(models.read_frames(frames, [models.HashReader]))
    assert [x.frame_ms for x in good.collect()] == [5] and [x.frame_ms for x in bad.collect()] == [6]


def test_sources_refuse_bad_input(spark, world):
    with pytest.raises(FileNotFoundError):
        (world / "empty" / "videos").mkdir(parents=True)
        videos.list_videos(spark, [f"{world}/empty"])
    with pytest.raises(ValueError, match="duplicate video id"):
        videos.list_videos(spark, [f"{world}/V3C1", f"{world}/V3C1/"])
    (world / "bad.jsonl").write_text('{"task_id": "a", "description": "x"}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED"):
        tables.read_jsonl(spark, f"{world}/bad.jsonl", schemas.TASK).collect()
    kept = tables.read_jsonl(spark, f"{world}/bad.jsonl", schemas.TASK, keep_bad=True).collect()
    assert [x._corrupt_record for x in kept if x._corrupt_record] == ["not json"]
    (world / "twice.jsonl").write_text('{"task_id": "a", "description": "x"}\n{"task_id": "a", "description": "y"}\n')
    with pytest.raises(ValueError, match="duplicate task_id"):
        tables.load_tasks(spark, f"{world}/twice.jsonl")
    with pytest.raises(ValueError, match="not complete"):
        corpus.describe(spark, f"{world}/none")


def test_candidates_fall_back_and_the_last_row_counts(spark, tmp_path):
    rows = [{"task_id": "a", "candidates": [{"video_id": "old", "shot_id": 1}]}, {"task_id": "b", "candidates": [], "results": [{"video_id": "r", "shot_id": 2, "rank": 9}]}, {"task_id": "a", "candidates": [{"video_id": "new", "shot_id": 3}, {"video_id": "n2", "shot_id": 4}]}, {"task_id": "c"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = sorted((x.task_id, x.position, x.video_id, x.rank) for x in tables.load_candidates(spark, str(tmp_path / "c.jsonl")).collect())
    assert got == [("a", 1, "new", 1), ("a", 2, "n2", 2), ("b", 1, "r", 9)]


def test_input_order_over_files(spark, tmp_path):
    """A large file first, then small ones: packing by size must not change which row is the last."""
    pad = "x" * 2000
    for k, n in enumerate((3, 400, 2, 1)):
        rows = [{"task_id": f"t{k}-{i}", "description": f"{pad}{k}"} for i in range(n)]
        (tmp_path / f"tasks{k}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    tasks = tables.load_tasks(spark, str(tmp_path / "tasks*.jsonl")).collect()
    want = [f"t{k}-{i}" for k, n in enumerate((3, 400, 2, 1)) for i in range(n)]
    assert [x.task_id for x in sorted(tasks, key=lambda x: x.task_pos)] == want
    for k, name in enumerate(("b", "a")):
        (tmp_path / f"{name}.cand").write_text("\n".join(json.dumps({"task_id": "a", "candidates": [{"video_id": f"v{k}{i}", "shot_id": 1}], "more": pad}) for i in range(5 - 4 * k)))
    paths = [str(tmp_path / "b.cand"), str(tmp_path / "a.cand")]
    assert [x.video_id for x in tables.load_candidates(spark, paths).collect()] == ["v10"]
    assert [x.video_id for x in tables.load_candidates(spark, paths[::-1]).collect()] == ["v04"]


def test_control_files_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "deep" / "state.json")
    for k in range(3):
        control.write(spark, path, {"k": k})
        assert control.read(spark, path) == {"k": k}
    assert [x.name for x in (tmp_path / "deep").iterdir() if not x.name.startswith(".")] == ["state.json"]


def test_ranked_frames_are_replaced_by_task(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 5), ("a", 700, 6), ("b", 1, 7)], "task_id string, rank long, frame_ms long")
    for _ in range(2):
        sinks.write_ranked(df, str(tmp_path / "r"))
    sinks.write_ranked(df.where("task_id = 'a'").withColumn("frame_ms", F.lit(9).cast("long")), str(tmp_path / "r"))
    assert sorted((x.task_id, x.frame_ms) for x in spark.read.parquet(str(tmp_path / "r")).collect()) == [("a", 9), ("b", 7)]


def test_embedding_of_arriving_files(spark, tmp_path):
    frame = spark.range(20).select(F.col("id").alias("source_index"), F.concat(F.lit("v:"), "id").alias("shot_uid"), F.lit("v").alias("video_id"), F.lit("/v.mp4").alias("video_path"), F.col("id").alias("shot_id"),
                                   F.lit(0).cast("long").alias("shot_start_ms"), F.lit(9).cast("long").alias("shot_end_ms"), F.col("id").alias("frame_ms"), F.lit("mid").alias("sample"))
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), [models.HashReader], lambda: models.HashEmbedder(64), 64)
    frame.where("source_index < 12").write.parquet(args[0])
    assert streaming.embed_arrivals(spark, *args, files_a_batch=1)["embedded"] == 12
    frame.where("source_index >= 12").write.mode("append").parquet(args[0])
    assert streaming.embed_arrivals(spark, *args)["embedded"] == 20
    assert corpus.read_corpora(spark, [args[1]]).select("source_index").distinct().count() == 20
    counts = streaming.rolling_counts(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    assert counts.agg(F.sum("n")).first()[0] == 1000


def test_doctor_and_command_line(spark, capsys):
    from framesift.__main__ import main

    said = main(["doctor", "--plugin", "framesift.models:HashScorer", "--path", "/root/testdata", "--path", "/no/such"])
    assert said["spark"] == spark.version and said["plugins"] == {"framesift.models:HashScorer": "ok"}
    assert said["paths"] == {"/root/testdata": True, "/no/such": False} and not said["ready"]

    def broken():
        raise RuntimeError("no weights")

    assert not commands.doctor(spark, [broken])["ready"]
