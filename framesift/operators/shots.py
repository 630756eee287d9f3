"""Segments from a detector's frame ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.sampling import frame_to_ms, half_even

#: Fixed value: frames a second of a video that tells none.
DEFAULT_FPS = 25.0


def video_meta(df: DataFrame) -> DataFrame:
    """``fps`` of 0 or less (or null) becomes the default; a video without frames is an error."""
    fps = F.when(F.coalesce(F.col("fps"), F.lit(0.0)) <= 0, F.lit(DEFAULT_FPS)).otherwise(F.col("fps").cast("double"))
    some = F.coalesce(F.col("frame_count"), F.lit(0)) > 0
    count = F.when(some, F.col("frame_count").cast("long")).otherwise(F.raise_error(F.concat(F.lit("no frames in "), F.col("video_id"))).cast("long"))
    return df.withColumns({"fps": fps, "frame_count": count})


def whole_if_empty(ranges: Column, frame_count: Column) -> Column:
    """A video without ranges is one segment."""
    everything = F.array(F.array(F.lit(0.0), (frame_count - 1).cast("double")))
    return F.when(F.coalesce(F.size(ranges), F.lit(0)) <= 0, everything).otherwise(ranges)


def normalise_ranges(df: DataFrame, ranges: str = "ranges") -> DataFrame:
    """One row a segment of ``df`` (video_id, fps, frame_count, ranges: array<array<double>>): shot_id (its
    place), frames rounded half to even, drawn into the video and put in order, and their times."""
    last = F.col("frame_count") - 1

    def frame(k: int) -> Column:
        value = F.when(F.size("range") >= 2, F.col("range")[k]).otherwise(F.raise_error(F.lit("a range needs two frames")).cast("double"))
        return F.greatest(F.lit(0).cast("long"), F.least(half_even(value), last))

    out = df.select("*", F.posexplode(whole_if_empty(F.col(ranges), F.col("frame_count"))).alias("shot_id", "range"))
    out = out.withColumns({"_a": frame(0), "_b": frame(1)})
    out = out.withColumns({"shot_id": F.col("shot_id").cast("long"), "start_frame": F.least("_a", "_b"), "end_frame": F.greatest("_a", "_b")})
    out = out.withColumns({"start_ms": frame_to_ms(F.col("start_frame"), F.col("fps")), "end_ms": frame_to_ms(F.col("end_frame"), F.col("fps"))})
    return out.drop("_a", "_b", "range", ranges)


def as_manifests(shots: DataFrame) -> DataFrame:
    """One row a video with its segments in order, as a shot manifest."""
    shot = F.struct("shot_id", "start_frame", "end_frame", "start_ms", "end_ms")
    return shots.groupBy("video_id", "video_path", "fps", "frame_count").agg(F.array_sort(F.collect_list(shot)).alias("shots"))
