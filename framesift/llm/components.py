"""Connected components of a graph given as edges: contraction within tasks, then alternating large-star and
small-star rounds.

Edges are dealt to tasks of at most ``TASK_EDGES``; each replaces its own by a star for each component that
they form. If that was one task the stars are the components. Else rounds follow until nothing changes. Each round is two aggregations of a minimum (combined before the shuffle) and two joins on a vertex, which
AQE can split where a vertex is hot; edges stay as many as vertices at most after the first rounds. Rounds
are cut by a table in the shared folder. Only counts reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.runtime import cut, discard, lean, ship

#: Rounds grow as the logarithm of the longest path; this many would be a fault in the input.
MOST_ROUNDS = 60
#: Edges that one task contracts at once: 16 MB of ids.
TASK_EDGES = 1 << 20


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n members, over the pairs (x, y)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which pairs (x < y) to keep so that all that hang together still do: for each y the smallest x, and
    of the others those that join two trees."""
    order = np.lexsort((x, y))
    keep = np.zeros(len(x), bool)
    first = np.ones(len(x), bool)
    first[1:] = y[order][1:] != y[order][:-1]
    keep[order[first]] = True
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for k in np.flatnonzero(keep).tolist():
        a, b = find(int(x[k])), find(int(y[k]))
        root[max(a, b)] = min(a, b)
    top = np.array([find(a) for a in range(n)])
    for k in np.flatnonzero(top[x] != top[y]).tolist():
        a, b = find(int(x[k])), find(int(y[k]))
        if a != b:
            root[max(a, b)] = min(a, b)
            keep[k] = True
    return keep


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (member, smallest member) of the components that a task's edges form, ``TASK_EDGES`` at a time."""
    held, rows = [], 0

    def stars() -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate(held), return_inverse=True)
        at = at.reshape(-1, 2)
        root = roots(len(ids), at[:, 0], at[:, 1])
        who = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(ids[root[who]])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()], 1).ravel())
            rows += batch.num_rows
            if rows >= TASK_EDGES:
                yield stars()
                held, rows = [], 0
    if held:
        yield stars()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (its smallest reachable id) for every id on an edge to another id. Loops,
    repeated edges and nulls don't matter. The result is a table written by ``cut``; the caller may discard it."""
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = now.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    ship(edges.sparkSession)
    every = cut(now.distinct(), "edges")
    before = _digest(every)
    tasks = -(-before[0] // (TASK_EDGES // 2)) or 1  # dealt round robin: none gets twice its share
    now = cut(every.repartition(tasks).mapInArrow(lean(contract), "a long, b long"), "edges")
    discard(every)
    for _ in range(MOST_ROUNDS if tasks > 1 else 0):
        # large-star: every larger neighbour of a vertex goes to the vertex's smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: every smaller neighbour of a vertex, and the vertex, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(last)
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = cut(stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct()), "components")
    discard(now)
    return out
