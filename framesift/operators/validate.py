"""Checks of inputs and outputs. A check is a DataFrame of faults; no faults, no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.operators.merge import union_all

MOST_RESULTS = 10


def task_faults(tasks: DataFrame, descriptions: bool = True) -> DataFrame:
    """task_id and fault: without id, duplicate, or (unless ``descriptions`` is off) without description."""
    empty = F.coalesce(F.col("task_id"), F.lit("")) == ""
    parts = [
        tasks.where(empty).select("task_id", F.lit("task without task_id").alias("fault")),
        tasks.where(~empty).groupBy("task_id").agg(F.count("*").alias("n")).where("n > 1").select("task_id", F.lit("duplicate task_id").alias("fault")),
    ]
    if descriptions:
        parts.append(tasks.where(~empty & (F.coalesce(F.col("description"), F.lit("")) == "")).select("task_id", F.lit("task without description").alias("fault")))
    return union_all(parts)


def require(faults: DataFrame) -> None:
    """Raise the first faults, if any."""
    found = [f"{r[0]}: {r[1]}" for r in faults.limit(10).collect()]
    if found:
        raise ValueError("; ".join(found))


def check_ranges(*, partitions: int = 1, index: int = 0, batch_size: int = 1, shard_size: int = 1, dimension: int = 64, decoder: str = "none", decoders: tuple[str, ...] = ("none",)) -> None:
    """Parameters of a run; a ValueError names the first that is out of range."""
    if partitions < 1 or not 0 <= index < partitions:
        raise ValueError("partition index must be in [0, partitions)")
    for name, value in (("batch_size", batch_size), ("shard_size", shard_size)):
        if value < 1:
            raise ValueError(f"{name} must be positive")
    if not 64 <= dimension <= 4096:
        raise ValueError("dimension must be in [64, 4096]")
    if decoder not in decoders:
        raise ValueError(f"decoder must be one of {', '.join(decoders)}")


def same_dimension(corpora: DataFrame) -> DataFrame:
    """Faults of corpora (corpus, complete, dimension): not complete, or of more than one dimension."""
    open_ = corpora.where(~F.coalesce("complete", F.lit(False))).select("corpus", F.lit("corpus is not complete").alias("fault"))
    odd = corpora.agg(F.countDistinct("dimension").alias("n")).where("n > 1").select(F.lit("all").alias("corpus"), F.lit("corpora differ in dimension").alias("fault"))
    return open_.unionByName(odd)


def result_faults(results: DataFrame, known_videos: DataFrame | None = None) -> DataFrame:
    """task_id and fault of typed results (task_id, rank, video_id, frame_ms): more than ten, ranks other than 1 to
    n, an empty or repeated or unknown video, a frame that is null or negative."""
    task = results.groupBy("task_id")
    n = task.agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("ranks"))
    parts = [
        n.where(F.col("n") > MOST_RESULTS).select("task_id", F.lit("more than 10 results").alias("fault")),
        n.where((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("ranks") != F.col("n")) | F.col("low").isNull()).select("task_id", F.lit("ranks are not 1 to n").alias("fault")),
        results.where(F.coalesce("video_id", F.lit("")) == "").select("task_id", F.lit("invalid video_id").alias("fault")),
        results.groupBy("task_id", "video_id").agg(F.count("*").alias("n")).where("n > 1").select("task_id", F.lit("duplicate video_id").alias("fault")),
        results.where(F.col("frame_ms").isNull()).select("task_id", F.lit("frame_ms is not an integer").alias("fault")),
        results.where(F.col("frame_ms") < 0).select("task_id", F.lit("frame_ms is negative").alias("fault")),
    ]
    if known_videos is not None:
        unknown = results.where(F.coalesce("video_id", F.lit("")) != "").join(known_videos.select("video_id"), "video_id", "left_anti")
        parts.append(unknown.select("task_id", F.lit("unknown video_id").alias("fault")))
    return union_all(parts).distinct()


def order_faults(predictions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Predictions (position, task_id) whose id or place differs from the tasks' (task_pos, task_id)."""
    both = predictions.join(tasks.select(F.col("task_pos").alias("position"), F.col("task_id").alias("expected")), "position", "full_outer")
    return both.where(~F.col("task_id").eqNullSafe(F.col("expected"))).select(F.coalesce("expected", "task_id").alias("task_id"), F.lit("task ids or their order differ").alias("fault"))


def submission_faults(spark: SparkSession, text: str, tasks: DataFrame, known_videos: DataFrame | None = None) -> DataFrame:
    """All faults of a submission given as JSON text, with the types that JSON has: a boolean or a fraction is no
    integer, a number no string."""
    raw = spark.createDataFrame([(text,)], "j string").select(F.parse_json("j").alias("v"))
    keys = F.json_object_keys("j")
    shape = spark.createDataFrame([(text,)], "j string").where(~F.coalesce(keys == F.array(F.lit("predictions")), F.lit(False)))
    faults = [shape.select(F.lit(None).cast("string").alias("task_id"), F.lit("predictions must be the only key").alias("fault"))]
    listed = raw.where(F.expr("schema_of_variant(variant_get(v, '$.predictions')) LIKE 'ARRAY%'"))
    if not listed.count():
        return union_all([*faults, raw.select(F.lit(None).cast("string").alias("task_id"), F.lit("predictions must be a list").alias("fault"))])
    each = listed.selectExpr("posexplode(cast(variant_get(v, '$.predictions') AS array<variant>)) AS (position, p)")
    each = each.selectExpr("cast(position AS bigint) AS position", "try_variant_get(p, '$.task_id', 'string') AS task_id", "variant_get(p, '$.results') AS r")
    is_list = "coalesce(schema_of_variant(r) LIKE 'ARRAY%', false)"
    faults += [order_faults(each.select("position", "task_id"), tasks), each.where(f"NOT {is_list}").select("task_id", F.lit("results must be a list").alias("fault"))]
    rows = each.where(is_list).selectExpr("task_id", "explode(cast(r AS array<variant>)) AS x")

    def whole(name: str) -> str:
        return f"CASE WHEN schema_of_variant(variant_get(x, '$.{name}')) = 'BIGINT' THEN try_variant_get(x, '$.{name}', 'bigint') END AS {name}"

    typed = rows.selectExpr("task_id", whole("rank"), "CASE WHEN schema_of_variant(variant_get(x, '$.video_id')) = 'STRING' THEN try_variant_get(x, '$.video_id', 'string') END AS video_id", whole("frame_ms"))
    return union_all([*faults, result_faults(typed, known_videos)])
