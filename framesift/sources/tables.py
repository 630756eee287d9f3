"""JSON inputs as tables: shot manifests, tasks, candidates, submissions, progress logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift import schemas
from framesift.functions.text import or_default
from framesift.operators import manifest, validate

STEM = r"([^/]+)\.json$"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, keep_bad: bool = False) -> DataFrame:
    """One JSON object a line; blank lines are skipped. A bad line is an error when it is read, or with ``keep_bad``
    a row whose ``_corrupt_record`` holds it."""
    if keep_bad:
        wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
        return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def in_input_order(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """Rows of JSON lines and the columns whose order is that of the input: files as listed (those of a folder by
    name), lines as they stand. Spark packs files into tasks by size, so a row's number in its task alone won't do."""
    parts = []
    for k, one in enumerate([path] if isinstance(path, str) else path):
        rows = read_jsonl(spark, one, schema)
        parts.append(rows.select("*", F.lit(k).alias("_input"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")))
    return reduce(DataFrame.unionByName, parts), ["_input", "_file", "_block", "_line"]


def read_shot_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row a video: video_id (the file's stem if it has none), video_path, fps, frame_count, shots, file_order."""
    rows = spark.read.schema(schemas.SHOT_MANIFEST).option("multiLine", "true").option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(folder)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file_order"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no shot manifests in {folder}")
    return rows.withColumn("video_id", or_default(F.col("video_id"), F.regexp_extract("file_order", STEM, 1)))


def shots_of(manifests: DataFrame) -> DataFrame:
    """One row a segment, in the order of its array."""
    out = manifests.select("file_order", "video_id", "video_path", F.posexplode("shots").alias("shot_pos", "s"))
    return out.select("file_order", "video_id", "video_path", "shot_pos", "s.shot_id", F.col("s.start_ms").alias("shot_start_ms"), F.col("s.end_ms").alias("shot_end_ms"))


def load_tasks(spark: SparkSession, path: str, descriptions: bool = True) -> DataFrame:
    """task_id (numbers count as text), description, task_pos (place in the file). Tasks without id, with an id
    that another has, or without description are errors; a null id is one without."""
    rows, order = in_input_order(spark, path, schemas.TASK)
    validate.require(validate.task_faults(rows.drop(*order), descriptions))
    return manifest.number_rows(rows, order, "task_pos").drop(*order)


def load_candidates(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a candidate, with task_id and ``position`` from 1 in its list. The list is ``candidates``, or
    ``results`` if that is empty. Of rows of one task the last
    in the order of the input counts."""
    rows, order = in_input_order(spark, path, schemas.CANDIDATE_LIST)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("task_id").orderBy(*map(F.desc, order)))).where("_n = 1")
    rows = rows.withColumn("list", F.when(F.size("candidates") > 0, F.col("candidates")).otherwise(F.col("results")))
    out = rows.select("task_id", F.posexplode("list").alias("position", "c")).select("task_id", (F.col("position") + 1).cast("long").alias("position"), "c.*")
    return out.withColumn("rank", F.coalesce("rank", "position"))


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """One row a task: position, task_id, results."""
    rows = spark.read.schema(schemas.SUBMISSION).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return rows.select(F.posexplode("predictions").alias("position", "p")).select(F.col("position").cast("long").alias("position"), "p.*")


def results_of(predictions: DataFrame) -> DataFrame:
    return predictions.select("task_id", F.inline("results"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Rows of finished tasks."""
    return read_jsonl(spark, path, schemas.PROGRESS).where("result IS NOT NULL")
