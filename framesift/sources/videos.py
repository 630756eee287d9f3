"""Video files: listing, and finding the file of a video."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.paths import fallback_path, path_candidates


def list_files(spark: SparkSession, root: str, pattern: str = "*.mp4") -> DataFrame:
    """Paths under ``root``, from the file system that Spark knows; contents are not read. Empty files are not listed."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def list_videos(spark: SparkSession, roots: list[str]) -> DataFrame:
    """video_id and path of root/videos/*/*.mp4 for each root, ordered by root and path; the id is the root's name in
    lower case, a line and the file's stem. A root without videos and an id that occurs twice are errors."""
    parts = []
    for k, root in enumerate(roots):
        name = root.rstrip("/").rsplit("/", 1)[-1].lower()
        files = list_files(spark, f"{root.rstrip('/')}/videos").where(F.col("path").rlike(r"/videos/[^/]+/[^/]+\.mp4$"))
        if files.isEmpty():
            raise FileNotFoundError(f"no videos under {root}")
        stem = F.regexp_extract("path", r"([^/]+)\.mp4$", 1)
        parts.append(files.select(F.lit(k).alias("root"), F.concat(F.lit(f"{name}_"), stem).alias("video_id"), "path"))
    every = reduce(DataFrame.unionByName, parts)
    twice = every.groupBy("video_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate video id {twice[0][0]}")
    return every.orderBy("root", "path").select("video_id", "path")


def resolve_paths(videos: DataFrame, files: DataFrame, root: str, hint: str = "video_path") -> DataFrame:
    """``videos`` with ``path`` (the first of its candidates that is among ``files``, else the one to name) and
    ``exists``. Joined, not probed file by file."""
    options = path_candidates(root, F.col("video_id"), F.col(hint))
    each = videos.select("video_id", F.posexplode(options).alias("pos", "path")).join(files.select("path").distinct(), "path")
    first = each.groupBy("video_id").agg(F.min_by("path", "pos").alias("_found"))
    out = videos.join(first, "video_id", "left")
    return out.withColumns({"path": F.coalesce("_found", fallback_path(options, F.col(hint))), "exists": F.col("_found").isNotNull()}).drop("_found")
