"""Exact top-k by inner product, with a KD-tree in each shard.

Space is split first: the upper levels of a KD-tree, median splits of the widest side, are fitted on a bounded sample
(``sample`` vectors) and deal every vector to a leaf; a leaf of more than ``shard_rows`` vectors is several shards, by a
hash. Each shard has a tight bounding box, one row of a small table. A query goes first to the shard whose box promises
most; its k-th best score there is propagated, and it goes on only to shards whose box can reach it. Vectors travel to
their shard and stay there, queries stream through it.

In a shard a tree splits at the median of the widest side, and keeps tight bounding boxes. The nodes are taken best first
by the most that a vector in the box can score (per component the better corner); the search ends when that is below the
k-th best score.

Equal vectors score alike and ties go to the smaller id, so of a vector's ids the k + 1 smallest (one may be the query's
own) can be among the best, each up to k times: the others need not travel, and a shard is bounded whatever repeats.

Defined cases: see ``quantised``; vectors are compared within each length; ties go to the smaller id; fewer candidates
than k give fewer rows; rows that repeat an id are candidates each, and one query together; a table without queries or
vectors gives no rows; other columns are ignored."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.runtime import cut, discard, lean, ship

LONG = (-(1 << 63), (1 << 63) - 1)
#: Bytes of boxes that a task meets queries with at once.
BOX_BYTES = 32 << 20


class Tree:
    """Nodes 0, 1, ...: ``lo`` and ``hi`` (boxes), ``span`` (rows of the reordered vectors), ``kids``."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = 256):
        self.lo, self.hi, self.span, self.kids = [], [], [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1)] if len(ids) else []
        while todo:
            a, b, parent = todo.pop()
            rows = vectors[order[a:b]]
            lo, hi = rows.min(0), rows.max(0)
            node = len(self.span)
            self.lo.append(lo), self.hi.append(hi), self.span.append((a, b)), self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(node)
            if b - a > leaf and (hi > lo).any():
                axis, half = int(np.argmax(hi - lo)), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, axis], half)]
                todo += [(a, a + half, node), (a + half, b, node)]
        self.vectors, self.ids = vectors[order], ids[order]
        if self.span:
            self.lo, self.hi = np.stack(self.lo), np.stack(self.hi)

    def nearest(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """Scores and ids, best first, of the k best whose id isn't ``own``; those below ``floor`` may lack."""
        if not self.span:
            return []
        most = np.maximum(self.lo * query, self.hi * query).sum(1)
        heap, best, kth = [(-most[0], 0)], [], floor
        while heap:
            bound, node = heapq.heappop(heap)
            if kth is not None and -bound < kth:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if kth is None or most[kid] >= kth:
                        heapq.heappush(heap, (-most[kid], kid))
                continue
            a, b = self.span[node]
            scores = self.vectors[a:b] @ query
            near = np.arange(b - a) if kth is None else np.flatnonzero(scores >= kth)
            if len(near) > 2 * k:  # of equal scores the smaller ids matter
                near = near[np.lexsort((self.ids[a:b][near], -scores[near]))[: k + int((self.ids[a:b][near] == own).sum())]]
            best += [(int(scores[i]), int(self.ids[a + i])) for i in near if self.ids[a + i] != own]
            if len(best) >= k:
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[k:]
                kth = best[-1][0] if kth is None else max(kth, best[-1][0])
        return sorted(best, key=lambda x: (-x[0], x[1]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _whole(column: pa.Array) -> np.ndarray:
    """floor(256 * x) of each component."""
    return np.floor(256.0 * _matrix(column))


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same numbers in a type in which their inner products are exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) * 2
    if bound < 2.0**53:
        return a, b
    if bound < 2.0**62:
        return a.astype(np.int64), b.astype(np.int64)
    return tuple(np.frompyfunc(int, 1, 1)(x) for x in (a, b))  # type: ignore[return-value]


def quantised(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """The rows that take part: id and vector not null, components neither null nor non-finite, and at least one."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    narrow = df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull)
    good = df.select(F.col(vec_id).cast("long").alias("id"), (F.col(vector) if narrow else F.col(vector).cast("array<double>")).alias("v"))
    return good.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size("v") > 0))


class Splits:
    """The upper levels of a KD-tree, from a sample: leaves of equal shares of it."""

    def __init__(self, rows: np.ndarray, leaves: int):
        self.axis, self.bar, self.kids, self.leaves = [], [], [], 0
        self._grow(rows, leaves)

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        node = len(self.axis)
        self.axis.append(-1), self.bar.append(0.0), self.kids.append((self.leaves, 0))
        side = rows.max(0) - rows.min(0) if leaves > 1 and len(rows) > 1 else np.zeros(1)
        if side.max() <= 0:
            self.leaves += 1
            return node
        axis = int(side.argmax())
        values = np.sort(rows[:, axis])
        bar = values[len(values) // 2]
        bar = bar if bar > values[0] else values[np.searchsorted(values, bar, side="right")]  # both sides get some
        low = rows[:, axis] < bar
        self.axis[node], self.bar[node] = axis, float(bar)
        self.kids[node] = (self._grow(rows[low], leaves // 2), self._grow(rows[~low], leaves - leaves // 2))
        return node

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while todo:
            node, who = todo.pop()
            if self.axis[node] < 0:
                out[who] = self.kids[node][0]
            elif len(who):
                low = rows[who, self.axis[node]] < self.bar[node]
                todo += [(self.kids[node][0], who[low]), (self.kids[node][1], who[~low])]
        return out


def _by_length(batch: pa.RecordBatch, column: str = "v", read=_whole) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and quantised vectors of each length of a batch."""
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, read(batch.column(column).take(pa.array(rows)))


def _boxes(shards: DataFrame) -> DataFrame:
    """shard, d, lo and hi of each shard, combined in tasks before the shuffle."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            boxes = "lo" in batch.schema.names
            for d, rows, low in _by_length(batch, "lo", _matrix) if boxes else _by_length(batch):
                high = _matrix(batch.column("hi").take(pa.array(rows))) if boxes else low
                shard = batch.column("shard").to_numpy()[rows]
                order = np.argsort(shard, kind="stable")
                at = np.flatnonzero(np.diff(shard[order], prepend=-1))
                for k, a, b in zip(shard[order][at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)):
                    old = found.get((int(k), d))
                    found[int(k), d] = [a, b] if old is None else [np.minimum(old[0], a), np.maximum(old[1], b)]
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in found], pa.int64()), pa.array([d for _, d in found], pa.int32()),
                pa.array([x[0] for x in found.values()], pa.list_(pa.float64())), pa.array([x[1] for x in found.values()], pa.list_(pa.float64())),
            ], names=["shard", "d", "lo", "hi"])

    schema = "shard long, d int, lo array<double>, hi array<double>"
    return shards.select("shard", "v").mapInArrow(combine, schema).repartition("shard").mapInArrow(combine, schema)


def top_k(df: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          shard_rows: int = 32768, sample: int = 16384, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: a condition on ``id``."""
    spark = df.sparkSession
    ship(spark)
    good = quantised(df, vec_id, vector)
    kind = good.schema["v"].dataType.simpleString()  # floats travel as such
    queries = cut(good.where(is_query).dropDuplicates(["id", "v"]), "queries")
    # of equal vectors the k + 1 smallest ids, each up to k times
    once = good.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    once = once.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1).select("id", "v", "times")
    vectors = cut(once, "vectors")
    sizes = {r["d"]: r["n"] for r in vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        discard(vectors, queries)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    drawn = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("v").toArrow().combine_chunks().to_batches()
    known = {d: rows for batch in drawn for d, _, rows in _by_length(batch)}
    splits = {d: Splits(known[d], min(-(-n // shard_rows), max(1, len(known[d]) // 16))) for d, n in sizes.items() if n > shard_rows and d in known}
    shared = spark.sparkContext.broadcast(splits)  # of a size that the sample bounds

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int32)
            for d, rows, m in _by_length(batch):
                if d in shared.value:
                    leaf[rows] = shared.value[d].leaf_of(m)
            yield batch.append_column("leaf", pa.array(leaf))

    assigned = vectors.mapInArrow(assign, f"id long, v {kind}, times int, leaf int").withColumn("d", F.size("v"))
    leaves = assigned.groupBy("d", "leaf").agg(F.count("*").alias("n")).orderBy("d", "leaf").collect()  # as many as the splits have
    base, numbered = 0, []
    for r in leaves:
        parts = -(-r["n"] // shard_rows)
        numbered.append((r["d"], r["leaf"], base, parts))
        base += parts
    table = F.broadcast(spark.createDataFrame(numbered, "d int, leaf int, base long, parts int"))
    shards = assigned.join(table, ["d", "leaf"]).withColumn("shard", F.col("base") + F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.col("parts"))).select("shard", "id", "v", "times")
    shards = cut(shards, "shards")
    boxes = _boxes(shards).toArrow().combine_chunks()  # one row a shard

    def bounds(floors: bool):
        """The shards that a query goes to: the one that promises most, or all others that can reach its floor."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = met.value
            for batch in batches:
                for d, rows, q in _by_length(batch):
                    if d not in mine:
                        continue
                    shard, lo, hi = mine[d]
                    step = max(1, BOX_BYTES // (8 * len(shard)))
                    for a in range(0, len(rows), step):
                        part, x = rows[a : a + step], q[a : a + step]
                        most = np.minimum(x, 0) @ lo.T + np.maximum(x, 0) @ hi.T  # of a box, per component the better corner
                        most += 1e-9 * (np.abs(x) @ np.maximum(np.abs(lo), np.abs(hi)).T)  # rounding must not lose a shard
                        at, to = np.arange(len(part)), most.argmax(1)
                        if floors:
                            floor = batch.column("floor").to_numpy(zero_copy_only=False)[part].astype(float)
                            reach = ~(most < floor[:, None])  # no floor: everywhere
                            reach[at, to] = False
                            at, to = np.nonzero(reach)
                        yield batch.take(pa.array(part[at])).append_column("shard", pa.array(shard[to]))

        return send

    by_size: dict[int, tuple] = {}
    for d in sizes:
        rows = np.flatnonzero(boxes["d"].to_numpy() == d)
        part = boxes.take(pa.array(rows))
        by_size[d] = (part["shard"].to_numpy(), *(np.stack(part[c].to_numpy()).astype(float).reshape(len(rows), d) for c in ("lo", "hi")))
    met = spark.sparkContext.broadcast(by_size)  # two corners a shard: some 1/10,000 of the vectors
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard come vectors first, then its queries."""
        now, held, tree, exact = None, [], None, None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(shard)]
            out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if shard[a] != now:
                    now, held, tree = shard[a], [], None
                part = batch.slice(a, b - a)
                if not kind[a]:
                    held.append((_whole(part.column("v")), part.column("id").to_numpy(), part.column("times").to_numpy()))
                    continue
                if not held:
                    continue
                if tree is None:
                    every = [np.concatenate(x) for x in zip(*held)]
                    every = [np.repeat(every[0], every[2], 0), np.repeat(every[1], every[2])]
                q = _whole(part.column("v"))
                left, right = _exact(every[0], q)
                if tree is None or left.dtype != exact:
                    tree, exact = Tree(left, every[1]), left.dtype
                for own, floor, x in zip(part.column("id").to_pylist(), part.column("floor").to_pylist(), right):
                    for score, vec in tree.nearest(x, own, k, floor):
                        out["query_id"].append(own), out["vec_id"].append(vec), out["score"].append(min(max(score, LONG[0]), LONG[1]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out.values()], names=list(out))

    def at_shards(asked: DataFrame) -> DataFrame:
        asked = asked.select("shard", F.lit(1).alias("kind"), "id", "v", F.lit(1).alias("times"), "floor")
        both = shards.select("shard", F.lit(0).alias("kind"), "id", "v", "times", F.lit(None).cast("long").alias("floor")).unionByName(asked)
        return both.repartition(tasks, "shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(search), "query_id long, vec_id long, score long")

    schema = f"id long, v {kind}, floor long, shard long"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = queries.withColumn("floor", F.lit(None).cast("long")).mapInArrow(bounds(False), schema)
    first = found = cut(at_shards(home), "home")
    if base > 1:
        kth = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        sent = queries.join(kth, "id", "left").mapInArrow(bounds(True), schema)
        found = found.unionByName(at_shards(sent))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = cut(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(vectors, queries, shards, first)
    return out
