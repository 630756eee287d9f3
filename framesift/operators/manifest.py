"""Frame manifests: one row a sampled frame, numbered without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.sampling import sample_frame_times
from framesift.functions.text import shot_uid


def sample_shots(shots: DataFrame, fps: float, start: str = "shot_start_ms", end: str = "shot_end_ms") -> DataFrame:
    """One row a sampled frame: frame_ms, sample, and ``sample_pos`` (its place in the segment)."""
    return shots.select("*", F.posexplode(sample_frame_times(start, end, fps)).alias("sample_pos", "_s")).select("*", "_s.frame_ms", "_s.sample").drop("_s")


#: Ranges that rows without a group are numbered in, and rows that are looked at to place their bounds.
RANGES, SAMPLE = 256, 8192


def _range_of(df: DataFrame, keys: list[Column]) -> Column:
    """The range that a row belongs to, from its keys alone: how many of some bounds it reaches. The bounds are
    literals, rows of ``df`` drawn by a hash, so a row's range is the same wherever and however often it is read."""
    row = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    drawn = row.orderBy(F.xxhash64(*row.columns)).limit(SAMPLE).orderBy(*row.columns).collect()
    every = max(1, len(drawn) // RANGES)
    bounds = list(dict.fromkeys(tuple(r) for r in drawn[every::every]))
    if not bounds:
        return F.lit(0)
    kinds = [f.dataType for f in row.schema.fields]
    literal = F.array(*(F.struct(*(F.lit(x).cast(t).alias(f"k{i}") for i, (x, t) in enumerate(zip(b, kinds)))) for b in bounds))
    own = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    return F.size(F.filter(literal, lambda b: b <= own))


def number_rows(df: DataFrame, order: list[Column | str], name: str = "source_index", group: str | None = None) -> DataFrame:
    """``df`` with 0, 1, ... in ``order``, without a window over all rows: rows are ranked within groups (of
    ``group``, whose order is the first of ``order``; else ranges of ``order``), and groups get their first number
    from the groups' counts before them, a table with one row a group. Null keys come first."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    if group is None:
        df = df.withColumn("_g", _range_of(df, keys))
        group = "_g"
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    starts = counts.select(F.col(group).alias("_k"), (F.sum("_n").over(Window.orderBy(group)) - F.col("_n")).alias("_from"))
    within = F.row_number().over(Window.partitionBy(group).orderBy(*keys)) - 1
    out = df.withColumn("_at", within).join(starts, F.col(group).eqNullSafe(F.col("_k")))
    return out.withColumn(name, (F.col("_from") + F.col("_at")).cast("long")).drop("_k", "_n", "_from", "_at", "_g")


def frame_manifest(shots: DataFrame, fps: float) -> DataFrame:
    """From segments (file_order, video_id, video_path, shot_pos, shot_id, shot_start_ms, shot_end_ms) their frames,
    numbered by file, place of the segment in its file, and sample. Segments keep the order of their array."""
    frames = sample_shots(shots, fps).withColumn("shot_uid", shot_uid(F.col("video_id"), F.col("shot_id")))
    frames = number_rows(frames, ["file_order", "shot_pos", "sample_pos"], group="file_order")
    return frames.select("source_index", "shot_uid", "video_id", "video_path", "shot_id", "shot_start_ms", "shot_end_ms", "frame_ms", "sample")


def manifest_stats(videos: DataFrame, fps: float, exists: str = "exists") -> DataFrame:
    """One row: videos, segments, frames, and videos whose file is missing. ``videos``: video_id, shots (array),
    exists. A video without segments counts."""
    n_shots = F.greatest(F.coalesce(F.size("shots"), F.lit(0)), F.lit(0))
    times = F.transform(F.coalesce("shots", F.array().cast(videos.schema["shots"].dataType)), lambda s: F.size(sample_frame_times(s["start_ms"], s["end_ms"], fps)))
    frames = F.aggregate(times, F.lit(0), lambda a, x: a + x)
    return videos.agg(
        F.count("*").alias("video_count"), F.coalesce(F.sum(n_shots), F.lit(0)).cast("long").alias("shot_count"),
        F.coalesce(F.sum(frames), F.lit(0)).cast("long").alias("frame_count"), F.count_if(~F.col(exists)).alias("missing_video_count"),
    )


def require_videos(videos: DataFrame, exists: str = "exists") -> DataFrame:
    """Strict mode: a missing file is an error when the row is read."""
    gone = F.raise_error(F.concat(F.lit("video not found: "), F.col("video_id"))).cast("boolean")
    return videos.withColumn(exists, F.when(F.col(exists), F.lit(True)).otherwise(gone))
