"""Exact top-k of unique segments for each query vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions import vectors

#: Bounds of a block of queries: bytes of vectors sent to every task, and rows that a task keeps for it.
QUERY_BYTES = 16 << 20
KEPT_ROWS = 400_000
#: Bytes of query vectors that the driver holds at once where blocks are not kept one by one.
DRIVER_BYTES = 256 << 20
#: Tasks that ``score_pairs`` takes at most.
FEW_TASKS = 4096


def score_pairs(tasks: DataFrame, frames: DataFrame) -> DataFrame:
    """Every task's dot product with every frame, in expressions: the reference form of what ``retrieve`` scores,
    for a few tasks (more than ``FEW_TASKS`` are refused). ``tasks``: task_id, query; ``frames``: embedding and payload."""
    if tasks.limit(FEW_TASKS + 1).count() > FEW_TASKS:
        raise ValueError("too many tasks for all pairs: use retrieve")
    pairs = frames.crossJoin(F.broadcast(tasks))
    return pairs.withColumn("score", vectors.dot(F.col("embedding"), F.col("query"))).drop("embedding", "query")


def best_per_group(df: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """The row of each group that comes first in ``order`` (each ascending): the smallest struct, combined
    before the shuffle."""
    names = [f"_o{k}" for k in range(len(order))]
    row = F.min(F.struct(*(o.alias(n) for o, n in zip(order, names)), *payload)).alias("_b")
    return df.groupBy(*keys).agg(row).select(*keys, *(f"_b.{p}" for p in payload))


def top_unique(scored: DataFrame, k: int, task: str = "task_id", unit: str = "shot_uid", score: str = "score", position: str = "source_index") -> DataFrame:
    """For each task the best row of each unit, and of these the k best, with ``rank`` from 1 and
    ``embedding_score``. Order: score downward, then position."""
    if k < 1:
        raise ValueError("k must be positive")
    payload = [c for c in scored.columns if c not in (task, unit)]
    best = best_per_group(scored, [task, unit], [-F.col(score), F.col(position)], payload)
    rank = F.row_number().over(Window.partitionBy(task).orderBy(F.desc(score), position))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)  # pruned before the cast, which would hide it
    return best.withColumns({"rank": F.col("rank").cast("long"), "embedding_score": F.col(score)})


def _partial(tasks: list[tuple[str, list[float]]], k: int, unit: str, position: str):
    """Of each batch of frames, each task's k best units: what a final top-k needs, and no more."""
    names, matrix = [t for t, _ in tasks], np.array([v for _, v in tasks], np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def best(rows: pa.Table) -> pa.Table:
            at = rows.column("_t").to_numpy()
            units = rows.column(unit).combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.lexsort((rows.column(position).to_numpy(), -rows.column("score").to_numpy(), at))
            key = at[order].astype(np.int64) * (int(units.max(initial=0)) + 1) + units[order]
            _, first = np.unique(key, return_index=True)
            order = order[np.sort(first)]
            task = at[order]
            place = np.arange(len(task)) - np.searchsorted(task, task)
            return rows.take(pa.array(order[place < k]))

        for batch in batches:
            column = batch.column("embedding")
            if pa.types.is_binary(column.type):  # 16 bits a component
                values = np.frombuffer(b"".join(column.to_pylist()), "<f2")
            else:
                values = column.flatten().to_numpy(zero_copy_only=False)
            values = values.astype(np.float64).reshape(batch.num_rows, matrix.shape[1])
            scores = values @ matrix.T
            few = min(k * 4, batch.num_rows)
            rows, n = [], batch.num_rows
            for t in range(len(names)):
                # the k-th best unit is among the best frames unless units repeat a lot: then all are looked at
                pick = np.argpartition(-scores[:, t], few - 1)[:few] if few < n else np.arange(n)
                if few < n:
                    units = batch.column(unit).take(pa.array(pick)).dictionary_encode().dictionary
                    if len(units) < k:
                        pick = np.arange(n)
                    else:
                        pick = np.flatnonzero(scores[:, t] >= scores[pick, t].min())  # ties at the edge
                part = batch.take(pa.array(pick)).drop_columns(["embedding"])
                rows.append(part.append_column("_t", pa.array(np.full(len(pick), t, np.int32))).append_column("score", pa.array(scores[pick, t])))
            if rows:
                kept = best(pa.Table.from_batches([*kept, *rows])).to_batches()
        for batch in pa.Table.from_batches(kept).combine_chunks().to_batches() if kept else []:
            label = pa.array(names).take(batch.column("_t"))
            yield batch.drop_columns(["_t"]).append_column("task_id", label)

    return scan


def _rounds(tasks: DataFrame, size: int, n: int) -> Iterator[list[tuple[str, list[float]]]]:
    """Blocks of about ``size`` queries by a hash of their task; one block at a time is on the driver."""
    blocks = -(-n // size)
    cast = tasks.select("task_id", F.transform("query", lambda x: x.cast("double")).alias("q"), F.pmod(F.xxhash64("task_id"), F.lit(blocks)).alias("_b"))
    for block in range(blocks):
        rows = sorted((r["task_id"], r["q"]) for r in cast.where(F.col("_b") == block).collect())
        if rows:
            yield rows


def retrieve(tasks: DataFrame, frames: DataFrame, k: int, unit: str = "shot_uid", position: str = "source_index", keep: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """``top_unique`` of all pairs, without making them: each task of Spark scores its frames against a block of
    query vectors by matrix products and passes on its k best units a query. Blocks are of a checked size, and there
    is one scan of the frames for each; frames are never collected. ``keep`` writes the answer of a block before the
    next one is fetched (see ``plans.commands``), so that the driver never has more than one; without it the blocks
    must fit ``DRIVER_BYTES`` together."""
    spark = frames.sparkSession
    first = tasks.select(F.count("*").alias("n"), F.max(F.size("query")).alias("d")).first()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields if f.name != "embedding")
    schema = f"{schema}, score double, task_id string"
    if not first["n"]:
        return top_unique(spark.createDataFrame([], schema), k, unit=unit, position=position)
    size = max(1, min(QUERY_BYTES // (8 * max(first["d"], 1)), KEPT_ROWS // k))
    if keep is None and first["n"] * 8 * max(first["d"], 1) > DRIVER_BYTES:
        raise ValueError("too many queries for the driver: give keep")
    parts = []
    for at, rows in enumerate(_rounds(tasks, size, first["n"])):
        found = top_unique(frames.mapInArrow(_partial(rows, k, unit, position), schema), k, unit=unit, position=position)
        parts.append(found if keep is None else keep(found, at))
    return reduce(DataFrame.unionByName, parts)
