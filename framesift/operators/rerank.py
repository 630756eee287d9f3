"""Two-stage scoring of candidates: coarse frames, a fine scan around the best, one frame a video.

All tasks run as one plan keyed by task_id. Frames are scored by a plug-in (see framesift.models) or any
function from frames to frames with a ``reranker_score``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.sampling import fine_scan_times, sample_frame_times
from framesift.functions.text import shot_uid

Scorer = Callable[[DataFrame], DataFrame]
#: Ties among coarse frames keep the order in which they are decoded; among fine ones too.
COARSE_TIES = ["video_id", "shot_start_ms", "shot_id", "frame_ms"]


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str, most: int | None = None) -> DataFrame:
    """``df`` with a row number from 1 within ``keys``; only those up to ``most``."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if most is not None:
        out = out.where(F.col(name) <= most)  # pruned before the cast, which would hide it
    return out.withColumn(name, F.col(name).cast("long"))


def _positive(**values: int) -> None:
    for name, value in values.items():
        if value < 1:
            raise ValueError(f"{name} must be positive")


def unique_shots(candidates: DataFrame, limit: int) -> DataFrame:
    """Of each task's candidates the first of each (video_id, shot_id) in rank order, ``limit`` in all, with
    ``position`` from 1."""
    _positive(limit=limit)
    first = numbered(candidates, ["task_id", "video_id", "shot_id"], ["rank"], "_n", 1).drop("_n")
    return numbered(first, ["task_id"], ["rank"], "position", limit)


def with_bounds(candidates: DataFrame, shots: DataFrame) -> DataFrame:
    """Missing bounds come from the shots (video_id, shot_id, start_ms, end_ms), else from the candidate's frame,
    else are 0; missing scores from ``score``, else 0. Shots may hold a bucketed or a small table: the
    planner picks the join."""
    known = shots.select("video_id", "shot_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e")).dropDuplicates(["video_id", "shot_id"])
    zero = F.lit(0).cast("long")
    out = candidates.withColumn("shot_id", F.coalesce("shot_id", F.lit(-1).cast("long"))).join(known, ["video_id", "shot_id"], "left")
    out = out.withColumns({
        "shot_start_ms": F.coalesce("shot_start_ms", "_s", "frame_ms", zero), "shot_end_ms": F.coalesce("shot_end_ms", "_e", "frame_ms", zero),
        "embedding_score": F.coalesce("embedding_score", "score", F.lit(0.0)), "frame_ms": F.coalesce("frame_ms", zero)})
    return out.drop("_s", "_e")


def coarse_frames(candidates: DataFrame, fps: float) -> DataFrame:
    """One row a sampled frame of each candidate."""
    keep = ["task_id", "video_id", *(c for c in ("video_path", "description") if c in candidates.columns), "shot_id", "shot_start_ms", "shot_end_ms", "embedding_score"]
    out = candidates.select(*keep, F.inline(sample_frame_times("shot_start_ms", "shot_end_ms", fps)))
    return out.withColumns({"shot_uid": shot_uid(F.col("video_id"), F.col("shot_id")), "scan_stage": F.lit("coarse"), "fine_center_ms": F.lit(None).cast("long")})


def best_first(ties: list[str]) -> list[Column | str]:
    return [F.desc("reranker_score"), F.desc("embedding_score"), *ties]


def best_per_shot(scored: DataFrame) -> DataFrame:
    return numbered(scored, ["task_id", "shot_uid"], best_first(COARSE_TIES), "_n", 1).drop("_n")


def fine_centers(coarse: DataFrame, limit: int) -> DataFrame:
    """The best frame of each of the ``limit`` best shots, with ``center_rank``."""
    _positive(limit=limit)
    return numbered(best_per_shot(coarse), ["task_id"], best_first(COARSE_TIES), "center_rank", limit)


def fine_frames(centers: DataFrame, coarse: DataFrame, window_ms: int, fps: float) -> DataFrame:
    """Frames around the centers that have not been scored yet: a frame counts by its shot, so shots that share a
    boundary both score it."""
    drop = ["sample", "scan_stage", "reranker_score", "center_rank", "fine_center_ms"]
    out = centers.withColumn("_c", F.col("frame_ms"))
    out = out.withColumn("frame_ms", F.explode(fine_scan_times("_c", "shot_start_ms", "shot_end_ms", window_ms, fps))).drop(*drop)
    out = out.withColumns({"sample": F.lit("fine"), "scan_stage": F.lit("fine"), "fine_center_ms": F.col("_c")}).drop("_c")
    key = ["task_id", "shot_uid", "frame_ms"]
    return out.join(coarse.select(*key), key, "left_anti").dropDuplicates(key)


def final_order(scored: DataFrame) -> DataFrame:
    """All scored frames with ``rank``: score, then fine before coarse, then the embedding's score, then the order
    in which they were decoded."""
    fine = F.col("scan_stage") == "fine"
    order = [
        F.desc("reranker_score"), fine.desc(), F.desc("embedding_score"), F.asc("video_id"),
        F.when(fine, F.col("fine_center_ms")).otherwise(F.col("shot_start_ms")), F.when(fine, F.lit(0).cast("long")).otherwise(F.col("shot_id")), "frame_ms", "shot_uid",
    ]
    return numbered(scored, ["task_id"], order, "rank")


def select_with_fallback(ranked: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """One frame a video, ``most`` a task: scored frames by rank, then candidates by position on videos not yet
    there, with the frame that retrieval found. task_id, rank, video_id, frame_ms, stage (0: scored, 1: fallback)."""
    _positive(most=most)
    zero = F.lit(0).cast("long")
    scored = ranked.select("task_id", "video_id", "frame_ms", F.lit(0).alias("stage"), F.col("rank").alias("at"))
    rest = candidates.select("task_id", "video_id", F.coalesce("frame_ms", zero).alias("frame_ms"), F.lit(1).alias("stage"), F.col("position").alias("at"))
    # Scored frames far down can't be chosen unless they are their video's first: prune before the union
    scored = numbered(scored, ["task_id", "video_id"], ["at"], "_n", 1).drop("_n")
    both = numbered(scored.unionByName(rest), ["task_id", "video_id"], ["stage", "at"], "_n", 1).drop("_n")
    return numbered(both, ["task_id"], ["stage", "at"], "rank", most).select("task_id", "rank", "video_id", "frame_ms", "stage")


def require_candidates(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Tasks, with an error for one without candidates."""
    has = candidates.select("task_id").distinct().withColumn("_has", F.lit(True))
    out = tasks.join(has, "task_id", "left")
    fault = F.raise_error(F.concat(F.lit("no candidates for task "), F.col("task_id"))).cast("boolean")
    return out.where(F.when(F.col("_has"), F.lit(True)).otherwise(fault)).drop("_has")


def nested_results(selected: DataFrame) -> DataFrame:
    """task_id and its results in rank order."""
    return selected.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "video_id", "frame_ms"))).alias("results"))


def task_stats(candidates: DataFrame, scored: DataFrame, centers: DataFrame) -> DataFrame:
    """Counts by task of candidate shots, coarse frames, centers and fine frames."""
    parts = [
        candidates.groupBy("task_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("candidate_shots")),
        scored.groupBy("task_id", F.concat("scan_stage", F.lit("_frames")).alias("what")).agg(F.count("*").alias("n")),
        centers.groupBy("task_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("fine_centers")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = ["candidate_shots", "coarse_frames", "fine_centers", "fine_frames"]
    return every.groupBy("task_id").agg(*(F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).cast("long").alias(n) for n in names))


class Rerank:
    """The whole stage, lazily: ``candidates``, ``coarse``, ``centers``, ``fine``, ``ranked``, ``selected``, ``stats``.

    ``score`` adds reranker_score. ``exists`` (video_id) names the videos that can be read: others get no frames,
    but may come in as a fallback. With ``keep`` (``DataFrame.persist``, say)
    candidates and scored frames, which later steps read several times, are computed once."""

    def __init__(self, candidates: DataFrame, shots: DataFrame, score: Scorer, exists: DataFrame | None = None, candidate_limit: int = 500, fine_top_k: int = 30,
                 window_ms: int = 750, fine_fps: float = 8.0, coarse_fps: float = 1.0, most: int = 10, keep: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.candidates = keep(with_bounds(unique_shots(candidates, candidate_limit), shots))
        readable = self.candidates if exists is None else self.candidates.join(exists.select("video_id").distinct(), "video_id", "left_semi")
        self.coarse = keep(score(coarse_frames(readable, coarse_fps)))
        self.centers = fine_centers(self.coarse, fine_top_k)
        self.fine = keep(score(fine_frames(self.centers, self.coarse, window_ms, fine_fps)))
        self.ranked = final_order(self.coarse.unionByName(self.fine, allowMissingColumns=True))
        self.selected = select_with_fallback(self.ranked, self.candidates, most)
        self.stats = task_stats(self.candidates, self.coarse.unionByName(self.fine, allowMissingColumns=True), self.centers)
