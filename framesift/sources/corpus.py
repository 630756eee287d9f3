"""Corpora of embedded frames: Parquet tables with a control file that says what is in them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.sources import control


def shard_table(frames: DataFrame) -> DataFrame:
    """One row a shard: rows, first and last source_index."""
    return frames.groupBy("index").agg(F.count("*").alias("count"), F.min("source_index").alias("first_source_index"), F.max("source_index").alias("last_source_index"))


def describe(spark: SparkSession, path: str) -> dict:
    """The corpus' control record; it must be complete."""
    state = control.read(spark, f"{path}/_corpus.json")
    if not state or not state.get("complete"):
        raise ValueError(f"corpus {path} is not complete")
    return state


def read_corpora(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The frames of one or more complete corpora of one dimension. Vectors are as they are stored: the scan reads both
    forms, ``vectors`` turns 16-bit ones into arrays."""
    if not paths:
        raise ValueError("no corpus")
    dimensions = {describe(spark, p)["dimension"] for p in paths}
    if len(dimensions) > 1:
        raise ValueError(f"corpora differ in dimension: {sorted(dimensions)}")
    parts = [spark.read.parquet(f"{p}/frames") for p in paths]
    if len({x.schema["embedding"].dataType for x in parts}) > 1:
        parts = [vectors(x) for x in parts]
    return reduce(DataFrame.unionByName, parts)


def vectors(frames: DataFrame) -> DataFrame:
    """``frames`` with ``embedding`` as an array of float, whichever way it is stored."""
    if not isinstance(frames.schema["embedding"].dataType, T.BinaryType):
        return frames

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if x is None else np.frombuffer(x, "<f2").astype(np.float32) for x in batch.column("embedding").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("embedding"), "embedding", pa.array(rows, pa.list_(pa.float32())))

    schema = T.StructType([f if f.name != "embedding" else T.StructField("embedding", T.ArrayType(T.FloatType())) for f in frames.schema.fields])
    return frames.mapInArrow(widen, schema)
