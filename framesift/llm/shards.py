"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets of about ``bucket_bytes`` by a seeded hash of the record.
Pass two gives each bucket a Fisher-Yates permutation seeded with (seed, bucket): the k-th record of the
bucket, in the order of its hash, goes to place ``perm[k]``. Buckets follow one another, so every record
has a place in one uniformly shuffled order, and shards are equal stretches of it: their row counts are
at most one apart (law ``rows``).

Records stream through pass two; a task holds a permutation (8 bytes a record), never a bucket's records,
so a bucket that a hot record (equal in all hashed columns) makes too large still fits. Spark's own
external sort brings records into order. Everything is a function of the records and the seed, so a
lost executor's partitions come out the same again.

Defined cases: null columns are hashed as nulls, null text has size 16; repeated rows are kept, each with
a place of its own; fewer rows than shards leave later shards empty; an empty table gives no rows. Extra
columns pass through; ``shard`` and ``slot`` must not exist yet unless they may be replaced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.runtime import ship

#: Fixed choice: bytes of text a record counts besides its text.
OVERHEAD = 16


def record_size(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus the overhead."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + OVERHEAD


def shuffle_into_shards(df: DataFrame, shards: int, identity: list[str], text: str = "text", seed: int = 17,
                        bucket_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... in each shard), the place of each
    record in a uniform shuffle. ``identity``: columns whose hash scatters the records."""
    spark = df.sparkSession
    ship(spark)
    df = df.drop("shard", "slot")
    total = df.agg(F.sum(record_size(text)).alias("b")).first()["b"] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    scattered = df.withColumn("_h", F.xxhash64(F.lit(seed), *identity)).withColumn("_b", F.pmod("_h", F.lit(buckets)))

    # One row of three numbers a bucket: total / bucket_bytes of them (3 million for 100 TB).
    counts = scattered.groupBy("_b").agg(F.count("*").alias("_n"))
    order = Window.orderBy("_b")
    counts = counts.select("_b", "_n", (F.sum("_n").over(order) - F.col("_n")).alias("_from"), F.sum("_n").over(Window.partitionBy()).alias("_all"))

    # Each bucket is a task of its own.
    dealt = scattered.repartitionById(buckets, F.col("_b").cast("int")).join(F.broadcast(counts), "_b").sortWithinPartitions("_b", "_h", *identity)
    schema = T.StructType([*df.schema.fields, T.StructField("_p", T.LongType()), T.StructField("_all", T.LongType())])
    names = df.columns

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, perm = None, 0, None
        for batch in batches:
            b, n = batch.column("_b").to_numpy(), batch.column("_n").to_numpy()
            start, place = batch.column("_from").to_numpy(), np.empty(batch.num_rows, np.int64)
            edges = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                if b[i] != now:
                    now, at = b[i], 0
                    perm = np.random.Generator(np.random.PCG64([seed, int(now)])).permutation(int(n[i]))
                place[i:j] = start[i] + perm[at : at + j - i]
                at += j - i
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(place), batch.column("_all")], names=[*names, "_p", "_all"])

    out = dealt.mapInArrow(places, schema)
    base, extra = F.expr(f"_all div {shards}"), F.expr(f"_all % {shards}")
    out = out.withColumn("_base", base).withColumn("_cut", extra * (F.col("_base") + 1)).withColumn("_extra", extra)
    shard = F.when(F.col("_p") < F.col("_cut"), F.expr("_p div (_base + 1)")).otherwise(F.expr("_extra + (_p - _cut) div greatest(_base, 1)"))
    slot = F.when(F.col("_p") < F.col("_cut"), F.expr("_p % (_base + 1)")).otherwise(F.expr("(_p - _cut) % greatest(_base, 1)"))
    return out.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).drop("_p", "_all", "_base", "_cut", "_extra")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; within a file records stand in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
