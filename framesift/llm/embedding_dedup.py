"""Near-duplicate vectors by iterative quantisation (ITQ) and multi-index Hamming tables.

On a bounded sample ITQ learns rotations whose signs are balanced binary codes: PCA, then alternating
between the nearest signs and the orthogonal (Procrustes) rotation towards them. A vector's code is cut into keys, one a
table; vectors with equal keys in a table meet in one of its buckets, with their ids and ``CODE`` bits of their codes, and
there the Hamming distance picks the promising pairs. A key is some bits short of telling vectors apart (buckets hold about
``BUCKET`` random vectors), so neighbouring keys are in one bucket and need not be probed one by one. A bucket gives a forest
of its promising pairs, not all of them. What hangs together by promising pairs is a group; each original vector of a
group travels there once, and there all pairs are decided by their cosine in double precision. A group gives counts and
stars, not pairs; buckets and groups beyond ``block`` members are split into block pairs.

The bits a key takes follow the logarithm of the number of vectors, and the number of tables follows from the recall wanted
for two vectors just at the threshold. How often such a pair's bits agree, and how far their codes are apart, is measured on
the sample about its mean: where vectors share a direction, pairs are wider apart about the mean, and more tables,
shorter keys or (all vectors close together) no keys at all make up for it. Every length has codes of its own; vectors of
a length that ``FEW`` have at most are one group.

Equal vectors are one row with a multiplicity, so copies are never expanded into pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part (no links, a component of
their own, kept); vectors of a null id too; vectors of different lengths never link. Vectors are scaled by their largest
component before the norm, so no finite one over- or underflows. Rows that repeat a vec_id are other vectors of the same id.
An empty table gives no rows; extra columns don't matter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.components import components, forest, roots
from framesift.llm.runtime import by_groups, cut, discard, in_blocks, lean, ship

#: Bits of a code that travel with an id (two longs); random vectors in a bucket; vectors that need no codes.
CODE, BUCKET, FEW = 128, 1024, 64


def usable(vector: str) -> Column:
    """No null or non-finite component, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def itq(sample: np.ndarray, bits: int, seed: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x bits) learned from ``sample``, in runs of at most dimension bits."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(d)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred / max(len(sample), 1) + 1e-9 * np.eye(d))
    out = []
    while sum(x.shape[1] for x in out) < bits:
        rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        reduced = centred @ axes
        for _ in range(rounds):
            signs = np.where(reduced @ rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(reduced.T @ signs)
            rotation = u @ vt
        out.append(axes @ rotation)
    return mean, np.concatenate([np.zeros((d, 0)), *out], 1)[:, :bits]


def plan(n: int, threshold: float, recall: float, widest: int = 28) -> tuple[int, int]:
    """Bits of a key, and tables: buckets of about ``BUCKET`` random vectors; ``recall`` at the threshold."""
    width = min(widest, max(1, math.ceil(math.log2(max(n, 2) / BUCKET))))
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** width
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))) if same < 1 else 1


def _at_threshold(sample: np.ndarray, threshold: float, seed: int, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``sample`` less its mean, and for each one as far from the mean whose distance is that of unit
    vectors with a cosine of ``threshold``, in the direction of another vector of the sample."""
    rng = np.random.default_rng(seed)
    centred = sample - sample.mean(0)
    x = centred[rng.permutation(len(centred))[:most]]
    square = np.maximum((x**2).sum(1, keepdims=True), 1e-12)
    side = centred[rng.integers(0, len(centred), len(x))] + 1e-6 * rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) / square * x
    side *= np.sqrt(square) / np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    cosine = np.clip(1 - (1 - threshold) / square, 0, 1)
    return x, cosine * x + np.sqrt(1 - cosine**2) * side


@dataclass
class Plan:
    """For the vectors of one length: bits of a key, tables, the number of the first one, the distance up to which codes
    are promising, and what ITQ learned."""

    width: int
    tables: int
    base: int
    reach: int
    mean: np.ndarray
    projection: np.ndarray

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.projection >= 0


def measured_plan(sample: np.ndarray, n: int, threshold: float, recall: float, seed: int, base: int = 0, many: int = 64, row: int = 4096) -> Plan:
    """The width is that of ``plan``; if ``recall`` takes more than ``many`` tables, the one of least cost, where a row in
    a table costs as much as ``row`` comparisons of codes. Width 0 compares all codes."""
    width, tables = plan(n, threshold, recall)
    x, y = _at_threshold(sample, threshold, seed)
    projection = itq(sample, max(width * tables, 4 * sample.shape[1]), seed)[1]
    agree = ((x @ projection >= 0) == (y @ projection >= 0)).mean(1)

    def enough(w: int) -> int:
        found = lambda t: np.mean(1 - (1 - agree**w) ** t) >= recall
        high = 1
        while not found(high) and high < 1 << 20:
            high *= 2
        low = high // 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if found(middle) else (middle, high)
        return high

    tables = max(tables, enough(width))
    if tables > many:
        width = min(range(width, -1, -1), key=lambda w: enough(w) * (row + n / 2**w))
        tables = enough(width)
    while True:
        mean, projection = itq(sample, max(CODE, width * tables), seed)
        same = (x @ projection >= 0) == (y @ projection >= 0)
        far = (~same[:, :CODE]).sum(1)
        reach = int(np.ceil(np.quantile(far, 0.9995)))
        met = same[:, : width * tables].reshape(len(x), tables, width).all(2).any(1)
        if (met & (far <= reach)).mean() >= recall:
            return Plan(width, tables, base, reach, mean, projection)
        tables = math.ceil(1.1 * tables)
        if tables > 2 * many * max(width, 1):
            width, tables = 0, 1


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of one length, of length 1; scaled by the largest component first."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def promising(left: np.ndarray, right: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tables of codes whose Hamming distance is at most the left row's ``reach``."""
    found, step = [], max(1, (1 << 20) // max(1, len(right)))
    for a in range(0, len(left), step):
        far = np.bitwise_count(left[a : a + step, None, 0] ^ right[None, :, 0])
        far += np.bitwise_count(left[a : a + step, None, 1] ^ right[None, :, 1])
        x, y = np.nonzero(far <= reach[a : a + step, None])
        found.append((x + a, y))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2  # type: ignore[return-value]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket (or block pair) a forest of the promising pairs."""
    for batch, edges in by_groups(batches, ["t", "key", "i", "j"]):
        ids, side, reach = (batch.column(c).to_numpy() for c in ("id", "side", "reach"))
        codes = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("c0", "c1")], 1)
        found = []
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a < 2:
                continue
            order = a + np.argsort(ids[a:b], kind="stable")
            left, right = (order[side[order] == 0], order[side[order] == 1]) if side[a:b].any() else (order, order)
            x, y = promising(codes[left], codes[right], reach[left])
            x, y = left[x], right[y]
            new = ids[x] < ids[y] if left is right else ids[x] != ids[y]
            x, y = x[new], y[new]
            if len(x) > 1:
                place = np.empty(b - a, np.int64)
                place[order - a] = np.arange(b - a)
                p, q = place[x - a], place[y - a]
                keep = forest(np.minimum(p, q), np.maximum(p, q), b - a)
                x, y = x[keep], y[keep]
            if len(x):
                found.append((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])


def _decide(threshold: float):
    """Of each group (or block pair) the members that have links, how many, and the smallest one each hangs together with."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in by_groups(batches, ["component", "i", "j"], 1024):
            ids, times, side = (batch.column(c).to_numpy() for c in ("id", "times", "side"))
            found = []
            for a, b in zip(edges[:-1], edges[1:]):
                order = a + np.argsort(ids[a:b], kind="stable")
                own, n = ids[order], b - a
                unit = _units(batch.column("v").take(pa.array(order)))
                two = bool(side[a:b].any())
                left = np.flatnonzero(side[order] == 0) if two else np.arange(n)
                right = np.flatnonzero(side[order] == 1) if two else left
                links, xs, ys = np.zeros(n, np.int64), [], []
                step = max(1, (1 << 21) // max(1, len(right)))
                for k in range(0, len(left), step):
                    part = left[k : k + step]
                    x, y = np.nonzero(unit[part] @ unit[right].T >= threshold)
                    x, y = part[x], right[y]
                    new = own[x] != own[y] if two else x < y
                    x, y = x[new], y[new]
                    links += np.bincount(x, times[order][y], n).astype(np.int64) + np.bincount(y, times[order][x], n).astype(np.int64)
                    tree = forest(np.minimum(x, y), np.maximum(x, y), n) if len(x) else slice(0)
                    xs.append(x[tree]), ys.append(y[tree])
                root = roots(n, np.concatenate(xs or [left[:0]]), np.concatenate(ys or [left[:0]]))
                who = np.flatnonzero(links)
                found.append((own[who], links[who], own[root[who]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["id", "n", "root"])

    return decide


def link(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.995,
         sample: int = 8192, block: int = 4096, seed: int = 5) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept. ``sample`` bounds what ITQ learns from, by length."""
    spark = df.sparkSession
    ship(spark)
    narrow = df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull)
    values = F.col(vector) if narrow else F.col(vector).cast("array<double>")  # floats travel as such; sums are of doubles
    every = df.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("v"))
    takes = F.coalesce(F.col("vec_id").isNotNull() & usable("v"), F.lit(False))
    good = every.where(takes)
    # A vector is a node, named by its smallest id, or by its hash where two vectors have the same (a repeated vec_id).
    distinct = cut(good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("times")), "vectors")
    twice = distinct.groupBy("least").agg(F.count("*").alias("n")).where("n > 1").select("least", F.lit(True).alias("twice"))
    twice = cut(twice, "twice")
    nodes = distinct.join(twice, "least", "left").select(F.when(F.col("twice"), F.xxhash64("v")).otherwise(F.col("least")).alias("id"), "least", "times", "v", F.size("v").alias("d"))
    sizes = {r["d"]: r["n"] for r in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64(F.lit(seed), "v"), "least"))
    drawn = distinct.withColumn("d", F.size("v")).withColumn("n", rank).where((F.col("n") <= sample) & F.col("d").isin([d for d, n in sizes.items() if n > FEW])).select("d", "v").toArrow().combine_chunks()
    plans: dict[int, Plan] = {}
    for d in sorted(d for d, n in sizes.items() if n > FEW):
        own = _units(drawn["v"].combine_chunks().take(pa.array(np.flatnonzero(drawn["d"].to_numpy() == d))))
        plans[d] = measured_plan(own, sizes[d], threshold, recall, seed, sum(p.tables for p in plans.values()))
    shared = spark.sparkContext.broadcast(plans)  # dimension x bits for each length that many have

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "key", "id", "c0", "c1", "reach"]
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(size).tolist():
                if d not in shared.value:
                    continue
                p, rows = shared.value[d], np.flatnonzero(size == d)
                power = 1 << np.arange(p.width, dtype=np.int64)
                for at in range(0, len(rows), 1024):
                    part = batch.take(pa.array(rows[at : at + 1024]))
                    bits, n = p.bits(_units(part.column("v"))), part.num_rows
                    code = np.packbits(bits[:, :CODE], axis=1).view(np.int64)
                    keys = (bits[:, : p.width * p.tables].reshape(n, p.tables, p.width) @ power).astype(np.int32)
                    again = np.tile(np.arange(n), p.tables)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(np.arange(p.tables, dtype=np.int32) + p.base, n)), pa.array(keys.T.ravel()), part.column("id").take(pa.array(again)),
                        pa.array(code[again, 0]), pa.array(code[again, 1]), pa.array(np.full(len(again), p.reach, np.int32)),
                    ], names=names)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(members: DataFrame, keys: list[str]) -> DataFrame:
        return members.repartition(tasks, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")

    spread = cut(nodes.select("id", "v").mapInArrow(lean(encode), "t int, key int, id long, c0 long, c1 long, reach int"), "codes")
    several = spread.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = in_blocks(spread.join(several, ["t", "key"]), ["t", "key"], "id", "size", block)
    pairs = dealt(met.select("t", "key", "i", "j", "side", "id", "c0", "c1", "reach"), ["t", "key"]).mapInArrow(lean(_meet), "a long, b long")
    group = components(pairs)
    few = [d for d, n in sizes.items() if n <= FEW]
    together = nodes.join(group, "id").unionByName(nodes.where(F.col("d").isin(few)).withColumn("component", -F.col("d").cast("long") - (1 << 62)))
    weight = together.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    together = in_blocks(together.join(weight, "component"), ["component"], "id", "size", block)
    found = cut(dealt(together.select("component", "i", "j", "side", "id", "times", "v"), ["component"]).mapInArrow(lean(_decide(threshold)), "id long, n long, root long"), "links")

    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    component = components(found.select("id", "root").distinct(), "id", "root")
    named = component.join(nodes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    named = component.join(named, "component").select("id", "component_id")
    classes = nodes.join(links, "id", "left").join(named, "id", "left").select("v", "times", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component_id", "least").alias("component_id"))
    members = good.join(classes, "v").select("vec_id", (F.col("n") + F.col("times") - 1).alias("n_links"), "component_id")
    rest = every.where(~takes).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = cut(members.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "linked")
    discard(distinct, twice, spread, group, found, component)
    return out
