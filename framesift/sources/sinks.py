"""Sinks. Tables are committed by Spark; small documents are written by the driver."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.sources import control

ARCHIVE_NAME = "submission.json"


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``embedding`` as the bytes of 16-bit floats."""
    for batch in batches:
        column = batch.column("embedding")
        values, ends = column.values.to_numpy(zero_copy_only=False).astype("<f2"), column.offsets.to_numpy()
        packed = pa.array([values[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist())], pa.binary())
        yield batch.set_column(batch.schema.get_field_index("embedding"), "embedding", packed)


def write_frames(df: DataFrame, path: str, shard_size: int, append: bool = False, half: bool = False) -> None:
    """Embedded frames in files of at most ``shard_size`` rows, sorted, so that cursors skip row groups. With ``half`` a
    component takes 16 bits (see ``corpus.vectors``), else 32."""
    if half:
        schema = T.StructType([f if f.name != "embedding" else T.StructField("embedding", T.BinaryType()) for f in df.schema.fields])
        df = df.mapInArrow(_halves, schema)
    df.sortWithinPartitions("source_index").write.mode("append" if append else "overwrite").option("maxRecordsPerFile", shard_size).parquet(path)


def write_candidates(ranked: DataFrame, path: str) -> None:
    """One JSON object a task, its candidates in rank order."""
    payload = [c for c in ranked.columns if c != "task_id"]
    row = F.struct("rank", *(c for c in payload if c != "rank"))
    write_jsonl(ranked.groupBy("task_id").agg(F.array_sort(F.collect_list(row)).alias("candidates")), path)


def write_ranked(ranked: DataFrame, path: str, most: int = 500) -> None:
    """The best scored frames of each task, a partition a task: writing a task again replaces it."""
    best = ranked.where(F.col("rank") <= most)
    best.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(path)


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and those with one, for a table of their own."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def write_submission(predictions: DataFrame, folder: str, archive: bool = True) -> dict:
    """submission.json and submission.zip from (task_pos, task_id, results): a few results a task."""
    spark = predictions.sparkSession
    rows = predictions.orderBy("task_pos").select("task_id", "results").collect()
    value = {"predictions": [{"task_id": r["task_id"], "results": [x.asDict() for x in r["results"] or []]} for r in rows]}
    text = json.dumps(value, ensure_ascii=False, indent=2) + "\n"
    control.write_bytes(spark, f"{folder}/submission.json", text.encode())
    if archive:
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(ARCHIVE_NAME, text)
        control.write_bytes(spark, f"{folder}/submission.zip", packed.getvalue())
    return value
