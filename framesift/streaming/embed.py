"""A corpus that grows as manifest files arrive: a file stream, embedded batch by batch.

A batch writes the folder of its own number, replacing what a run that was cut off left there, so each frame
is in the corpus once. The stream's checkpoint is the cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift import models, schemas
from framesift.sources import control, sinks


def embed_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, readers: list[Callable], embedder: Callable, dimension: int,
                   shard_size: int = 2048, files_a_batch: int = 100, schema: T.StructType = schemas.FRAME) -> dict:
    """Embed all Parquet manifest files in ``folder`` that no run has seen, and return."""

    def batch(frames: DataFrame, number: int) -> None:
        seen = models.read_frames(frames, readers).persist()
        name = f"chunk={number:06d}"
        good = seen.where(F.col("image").isNotNull()).drop("error", "decoder")
        sinks.write_frames(models.embed(good, "image", embedder, dimension), f"{out}/frames/{name}", shard_size)
        seen.where(F.col("image").isNull()).drop("image").write.mode("overwrite").parquet(f"{out}/failed/{name}")
        seen.unpersist()

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    n = spark.read.parquet(f"{out}/frames").count() if control.exists(spark, f"{out}/frames") else 0
    state = {"complete": True, "dimension": dimension, "embedded": n}
    control.write(spark, f"{out}/_corpus.json", state)
    return state


def rolling_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes", at: str = "ts", key: str = "event_type") -> DataFrame:
    """Events and their sum of values by window and key; events later than ``late`` are left out of a stream."""
    when = F.col(at).cast("timestamp")
    return events.withColumn("_at", when).withWatermark("_at", late).groupBy(F.window("_at", window), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
