"""The commands: shots, make-manifest, embed-corpus, retrieve, rerank, merges, validate, doctor.

Each resumes: what is done under the same configuration is not done again, and state of another configuration
is refused. A command returns a summary."""

from __future__ import annotations

import importlib.metadata
import platform
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift import models, schemas
from framesift.operators import manifest, merge, partition, rerank, shots, topk, validate
from framesift.session import tune
from framesift.sources import control, corpus, sinks, tables, videos

Factory = Callable[[], object]


def _versions(*names: str) -> dict:
    found = {}
    for name in names:
        try:
            found[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            found[name] = "missing"
    return found


def doctor(spark: SparkSession, plugins: list[Factory] = (), paths: list[str] = ()) -> dict:
    """Versions of what runs here, whether each plug-in can be made where tasks run, and whether paths can be read."""
    found = {"python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master} | _versions("pyspark", "pyarrow", "pandas", "numpy")
    found["shared_folder"] = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    found["plugins"] = {models.name_of(f): models.can_make(spark, f) for f in plugins}
    found["paths"] = {p: control.exists(spark, p) for p in paths}
    found["ready"] = all(x == "ok" for x in found["plugins"].values()) and all(found["paths"].values())
    return found


def _provenance(spark: SparkSession) -> dict:
    """What a run's results may depend on beside its configuration; kept, but not compared."""
    return {"python": platform.python_version(), "spark": spark.version} | _versions("framesift", "pyarrow", "numpy")


def make_shots(spark: SparkSession, roots: list[str], out: str, detector: Factory, index: int = 0, parts: int = 1, dry_run: int = 0, overwrite: bool = False) -> dict:
    """Detect segments of all videos; those with a manifest are skipped unless ``overwrite``; failures go to a log."""
    partition.check_partition(index, parts)
    config = {"roots": roots, "detector": models.name_of(detector), "index": index, "parts": parts}
    listed = manifest.number_rows(videos.list_videos(spark, roots), ["video_id"], "position")
    mine = partition.take_partition(listed, index, parts, "position")
    if dry_run:
        rows = partition.first_rows(mine, dry_run, ["position"]).collect()
        return {"dry_run": [r["video_id"] for r in rows]}
    control.same_run(spark, f"{out}/_config.json", config, control.exists(spark, f"{out}/manifests") and not overwrite, overwrite)
    control.write(spark, f"{out}/_provenance.json", _provenance(spark))
    todo = mine
    if control.exists(spark, f"{out}/manifests") and not overwrite:
        done = spark.read.schema(schemas.SHOT_MANIFEST).json(f"{out}/manifests").select("video_id")
        todo = partition.without_done(mine, done, ["video_id"])
    found = models.detect(todo, detector).persist()
    good, bad = sinks.split_failures(found)
    segments = shots.normalise_ranges(shots.video_meta(good.withColumnRenamed("path", "video_path").drop("error_type")))
    sinks.write_jsonl(shots.as_manifests(segments), f"{out}/manifests", append=not overwrite)
    sinks.write_jsonl(bad.select("video_id", F.col("path").alias("video_path"), "error_type", "error"), f"{out}/failures", append=True)
    every, failed, ran = mine.count(), bad.count(), found.count()
    found.unpersist()
    return {"completed": ran - failed, "skipped": every - ran, "failed": failed, "exit_code": int(failed > 0)}


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests as a file a video, or as written by ``make_shots``."""
    if control.exists(spark, f"{folder}/manifests"):
        return spark.read.schema(schemas.SHOT_MANIFEST).json(f"{folder}/manifests").withColumn("file_order", F.col("video_id"))
    return tables.read_shot_manifests(spark, folder)


def make_manifest(spark: SparkSession, shots_dir: str, video_root: str, out: str, long_shot_fps: float = 0.25, strict: bool = False) -> dict:
    """The frame manifest of all segments, and counts."""
    rows = videos.resolve_paths(_manifests(spark, shots_dir), videos.list_files(spark, video_root), video_root)
    if strict:
        rows = manifest.require_videos(rows)
    rows = rows.withColumn("video_path", F.col("path"))
    frames = manifest.frame_manifest(tables.shots_of(rows.where("exists OR NOT exists")), long_shot_fps)
    frames.write.mode("overwrite").parquet(out)
    return manifest.manifest_stats(rows, long_shot_fps).first().asDict() | {"long_shot_fps": long_shot_fps, "output": out}


def embed_corpus(spark: SparkSession, manifest_path: str, out: str, reader: list[Factory], embedder: Factory, dimension: int = 4096, shard_size: int = 2048,
                 index: int = 0, parts: int = 1, chunk: int = 1 << 20, config: dict | None = None, side: int = 512, batch_size: int = 0, half: bool = True) -> dict:
    """Embed the manifest's frames in chunks of source_index. After each chunk the control file moves the cursor;
    a chunk that was cut off is written again in full. Frames that can't be read go to a dead-letter table. A state that
    another manifest, plug-in or setting made is refused. With ``half`` vectors take 16 bits a component."""
    validate.check_ranges(partitions=parts, index=index, shard_size=shard_size, dimension=dimension)
    tune(spark)
    frames = partition.take_partition(spark.read.parquet(manifest_path), index, parts, "source_index")
    state = control.read(spark, f"{out}/_corpus.json")
    own = {"manifest": manifest_path, "manifest_sha256": control.digest(spark, manifest_path), "dimension": dimension, "shard_size": shard_size, "index": index, "parts": parts,
           "readers": [models.name_of(f) for f in reader], "embedder": models.name_of(embedder), "side": side, "batch_size": batch_size, "half": half} | (config or {})
    control.same_run(spark, f"{out}/_config.json", own, state is not None)
    control.write(spark, f"{out}/_provenance.json", _provenance(spark))
    state = state or {"cursor": -1, "embedded": 0, "failed": 0, "complete": False, "dimension": dimension, "chunks": [], "embedder": own["embedder"]}
    started = time.monotonic()
    top = frames.agg(F.max("source_index")).first()[0]
    while not state["complete"]:
        if top is None or state["cursor"] >= top:
            state["complete"] = True
            control.write(spark, f"{out}/_corpus.json", state)
            break
        upto = state["cursor"] + chunk
        part = partition.after_cursor(frames, state["cursor"]).where(F.col("source_index") <= upto)
        seen = models.read_frames(part, reader, side).persist()
        good, bad = seen.where(F.col("image").isNotNull()).drop("error", "decoder"), seen.where(F.col("image").isNull()).drop("image")
        name = f"chunk={len(state['chunks']):06d}"
        sinks.write_frames(models.embed(good, "image", embedder, dimension, batch_size=batch_size), f"{out}/frames/{name}", shard_size, half=half)
        bad.write.mode("overwrite").parquet(f"{out}/failed/{name}")
        n, failed = good.count(), bad.count()
        seen.unpersist()
        state |= {"cursor": upto, "embedded": state["embedded"] + n, "failed": state["failed"] + failed, "chunks": [*state["chunks"], {"rows": n, "failed": failed}]}
        control.write(spark, f"{out}/_corpus.json", state)
    return state | {"seconds": round(time.monotonic() - started, 3)}


def retrieve(spark: SparkSession, tasks_path: str, corpora: list[str], out: str, embedder: Factory, top_k: int = 3000, index: int = 0, parts: int = 1, reuse: bool = False,
             instruction: str = "", batch_size: int = 0) -> dict:
    """The k best unique segments for each task, from all corpora. With ``reuse`` an output that was written in full
    under the same configuration (tasks, corpora, plug-in, instruction) is kept. Corpora must be those of the same plug-in."""
    partition.check_partition(index, parts)
    tune(spark)
    states = [corpus.describe(spark, c) for c in corpora]
    name = models.name_of(embedder)
    config = {"tasks": tasks_path, "tasks_sha256": control.digest(spark, tasks_path), "corpora": corpora, "chunks": [len(x.get("chunks", [])) for x in states], "embedded": [x["embedded"] for x in states],
              "top_k": top_k, "index": index, "parts": parts, "embedder": name, "instruction": instruction, "batch_size": batch_size}
    if others := {x["embedder"] for x in states if x.get("embedder") not in (None, name)}:
        raise ValueError(f"corpora were embedded by {', '.join(sorted(others))}, not by {name}")
    if reuse and control.exists(spark, f"{out}/_SUCCESS") and control.read(spark, f"{out}/_config.json") == config:
        return config | {"output": out, "reused": True}
    tasks = partition.take_partition(tables.load_tasks(spark, tasks_path), index, parts, "task_pos")
    queries = models.embed(tasks, "description", embedder, states[0]["dimension"], "query", instruction, batch_size).select("task_id", "query")
    frames = corpus.read_corpora(spark, corpora).drop("chunk")
    control.delete(spark, f"{out}/_config.json")
    kept = f"{out}_blocks"
    found = topk.retrieve(queries, frames, top_k, keep=lambda df, at: _kept(df, f"{kept}/{at:06d}"))
    sinks.write_candidates(found, out)
    control.delete(spark, kept)
    control.write(spark, f"{out}/_config.json", config)  # names that begin with _ are no data
    return config | {"output": out, "reused": False}


def _kept(df: DataFrame, path: str) -> DataFrame:
    """A block's answer, written beside the output, so that the driver holds one block of queries at a time."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rerank_tasks(spark: SparkSession, tasks_path: str, candidates: list[str], shots_dir: str, video_root: str, out: str, readers: list[Factory], scorer: Factory,
                 candidate_limit: int = 500, fine_top_k: int = 30, window_ms: int = 750, fine_fps: float = 8.0, long_shot_fps: float = 1.0, most: int = 10,
                 index: int = 0, parts: int = 1, archive: bool = True, instruction: str = "", chunk: int = 0, side: int = 512) -> dict:
    """Score, scan finely, select; writes ranked frames, progress and the submission of this part of the tasks."""
    tune(spark)
    partition.check_partition(index, parts)
    everyone = tables.load_tasks(spark, tasks_path)
    mine = partition.take_partition(everyone, index, parts, "task_pos")
    config = {"tasks": tasks_path, "tasks_sha256": control.digest(spark, tasks_path), "candidates": candidates, "candidates_sha256": control.digest(spark, *candidates),
              "shots_dir": shots_dir, "video_root": video_root, "readers": [models.name_of(f) for f in readers], "scorer": models.name_of(scorer),
              "instruction": instruction, "chunk": chunk, "side": side, "candidate_limit": candidate_limit, "fine_top_k": fine_top_k, "window_ms": window_ms, "fine_fps": fine_fps,
              "long_shot_fps": long_shot_fps, "most": most, "index": index, "parts": parts}
    log = f"{out}/progress"
    control.same_run(spark, f"{out}/_config.json", config, control.exists(spark, log))
    control.write(spark, f"{out}/_provenance.json", _provenance(spark))
    todo, done, held = mine, None, []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    if control.exists(spark, log):
        done = tables.read_progress(spark, log)
        todo = partition.without_done(mine, done, ["task_id"])
    started = time.monotonic()
    todo = keep(todo)
    if not todo.isEmpty():
        found = tables.load_candidates(spark, candidates)
        found = rerank.require_candidates(todo, found).select("task_id", "description").join(found, "task_id")
        known = _manifests(spark, shots_dir).select("video_id", F.inline("shots")).select("video_id", "shot_id", "start_ms", "end_ms")
        files = videos.list_files(spark, video_root)
        placed = videos.resolve_paths(found.select("video_id", "video_path").groupBy("video_id").agg(F.min("video_path").alias("video_path")), files, video_root)
        placed = keep(placed)
        found = found.drop("video_path").join(placed.select("video_id", F.col("path").alias("video_path")), "video_id")
        found = found.withColumn("rank", F.col("position")).drop("position")
        stage = rerank.Rerank(found, known, models.read_and_score(readers, scorer, side, instruction, chunk), placed.where("exists"), candidate_limit, fine_top_k, window_ms, fine_fps, long_shot_fps, most, keep)
        sinks.write_ranked(stage.ranked.select("task_id", "video_id", "shot_id", "frame_ms", "reranker_score", "embedding_score", "scan_stage", "rank"), f"{out}/ranked")
        total = mine.count()
        rows = todo.select("task_id", "task_pos").join(rerank.nested_results(stage.selected), "task_id", "left").join(stage.stats, "task_id", "left")
        rows = rows.select("task_id", F.col("task_pos").alias("task_index"), F.lit(total).cast("long").alias("task_total"), "candidate_shots", "coarse_frames", "fine_centers", "fine_frames",
                           F.round(F.lit(time.monotonic() - started), 3).alias("seconds"), F.struct("task_id", F.coalesce("results", F.array().cast("array<struct<rank:bigint,video_id:string,frame_ms:bigint>>")).alias("results")).alias("result"))
        sinks.write_jsonl(rows, log, append=True)
    for df in held:
        df.unpersist()
    finished = tables.read_progress(spark, log).select("task_id", F.col("result.results").alias("results")).dropDuplicates(["task_id"])
    ordered = merge.merge([finished], mine)
    sinks.write_submission(ordered, out, archive)
    return {"tasks": ordered.count(), "seconds": round(time.monotonic() - started, 3), "output": out}


def merge_candidates(spark: SparkSession, inputs: list[str], tasks_path: str, out: str) -> dict:
    """Candidate lists of all parts, complete and in task order."""
    tasks = tables.load_tasks(spark, tasks_path)
    parts = [tables.read_jsonl(spark, p, schemas.CANDIDATE_LIST) for p in inputs]
    merged = merge.merge(parts, tasks)
    sinks.write_jsonl(merged.coalesce(1).sortWithinPartitions("task_pos").select("task_id", "candidates"), out)
    return {"tasks": merged.count(), "output": out}


def merge_submissions(spark: SparkSession, inputs: list[str], tasks_path: str, out: str, archive: bool = True) -> dict:
    tasks = tables.load_tasks(spark, tasks_path)
    parts = [tables.read_submission(spark, p).drop("position") for p in inputs]
    value = sinks.write_submission(merge.merge(parts, tasks), out, archive)
    return {"tasks": len(value["predictions"]), "output": out}


def validate_submission(spark: SparkSession, submission: str, tasks_path: str, shots_dir: str | None = None) -> dict:
    """Raise the faults of a submission, or count its tasks and results."""
    tasks = tables.load_tasks(spark, tasks_path, descriptions=False)
    known = None
    if shots_dir:
        known = _manifests(spark, shots_dir).select("video_id")
    data = control.read_bytes(spark, submission)
    if data is None:
        raise FileNotFoundError(submission)
    validate.require(validate.submission_faults(spark, data.decode(), tasks, known))
    rows = tables.read_submission(spark, submission)
    counts = rows.agg(F.count("*").alias("tasks"), F.sum(F.size("results")).alias("results")).first()
    return {"tasks": counts["tasks"], "results": counts["results"] or 0}
