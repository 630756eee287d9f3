"""Near-duplicate texts by DartMinHash signatures and banded joining, decided by exact Jaccard similarity.

A text is the weighted set of its runs of five words (weight 1, or the number of times with
``weighted=True``). Darts are thrown at each element: hashed points of rate 1 over weight x rank, found for
each strip of weights [2**v - 1, 2**(v+1) - 1) as arrival times with hashed exponential gaps. A dart counts
if it falls below the element's weight; only ranks up to theta = t / (total weight) are thrown, about t darts a
text whatever its length. Each dart has a coordinate, and the earliest dart of a coordinate is the
signature's value there; coordinates left empty get more darts by doubling theta. Two signatures agree at a
coordinate with the probability of the (weighted) Jaccard similarity.

Texts with equal sets (by 128 bits of hash, of words without arithmetic structure) are one class and enter once. Classes that agree in a band of coordinates meet in a
bucket, where whole signatures are compared; a bucket gives a forest of its promising pairs, not all of them.
What hangs together by promising pairs is a group; each text of a group of several travels there once, others are
sieved out before the shuffle, and there all exact similarities are found at once, as a product of sparse incidences with the runs that two texts
share. A group gives stars, not pairs. So no link within a group is lost, and copies are never expanded into
pairs. Buckets and groups beyond ``block`` members, and groups beyond ``block_bytes``, are split into block pairs. A pair just at 0.8 is missed with
a probability of 3e-5 by the bands (20 of 4) and of 4e-6 by the comparison of signatures (at least 0.6 of 80
agree), and then only if nothing else brings both into one group.

Words are [^\\x20\\x09-\\x0D]+, unchanged. Defined cases: a text of one to four words is one run; texts without
words and rows of null doc_id take no part (a class of their own); rows that share a doc_id are judged each by
its text; ties go to the smaller doc_id; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.components import components, forest, roots
from framesift.llm.runtime import by_groups, cut, discard, flat, in_blocks, lean, pieces, ship, sieve
from framesift.llm.wordbytes import BLANKS, Words, mix, runs, whole


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 4
    slack: float = 0.2  # a pair is promising if at least similarity - slack of the coordinates agree
    weighted: bool = False
    block: int = 512
    block_bytes: int = 4 << 20

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def shingles(words: Words, width: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, distinct runs of words (sorted by row and run) and how often each stands there."""
    ok, hashes = whole(words.first, width), words.more if lane else words.hash
    row, run = words.doc[: len(ok)][ok], runs(hashes, width, seed=11)[ok]
    length = np.diff(words.first)
    for n in range(1, width):
        short = np.flatnonzero(length == n)
        if len(short):
            row, run = np.concatenate([row, short]), np.concatenate([run, runs(hashes, n, seed=11 + n)[words.first[short]]])
    order = np.lexsort((run, row))
    row, run = row[order], run[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (run[1:] != run[:-1])
    at = np.flatnonzero(new)
    return row[at], run[at], np.diff(np.append(at, len(row)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def darts(row: np.ndarray, element: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids and ranks of the darts of rank up to theta[row] that fall below their element's weight."""
    out: list[tuple] = []
    strip, low = 0, 0.0
    inside = np.arange(len(row))
    while len(inside):
        width = 2.0**strip
        inside = inside[weight[inside] > low]
        at, key = inside, mix(element[inside] + np.uint64(strip * 0x9E3779B97F4A7C15 % (1 << 64)))
        rank, step = np.zeros(len(at)), 0
        while len(at):
            dart = mix(key + np.uint64(step * 0xC2B2AE3D27D4EB4F % (1 << 64)))
            rank = rank - np.log(_uniform(dart)) / width
            near = rank <= theta[row[at]]
            at, key, rank, dart = at[near], key[near], rank[near], dart[near]
            below = low + width * _uniform(mix(dart ^ np.uint64(0x165667B19E3779F9))) < weight[at] if strip else np.ones(len(at), bool)
            out.append((row[at][below], dart[below], rank[below]))
            step += 1
        strip, low = strip + 1, low + width
    if not out:
        return row[:0], element[:0], np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k: the earliest dart of each coordinate, as 32 bits. Rows without elements are left 0."""
    out = np.zeros((n, k), np.uint32)
    total = np.bincount(row, weight, n)
    todo, t = np.flatnonzero(total > 0), k * np.log(k) + 2 * k
    while len(todo):
        theta = np.zeros(n)
        theta[todo] = t / total[todo]
        mine = theta[row] > 0
        r, dart, rank = darts(row[mine], element[mine], weight[mine], theta)
        cell = r * k + (mix(dart) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, cell))
        cell, dart = cell[order], dart[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        cell, dart = cell[first], dart[first]
        out.reshape(-1)[cell] = (dart >> np.uint64(32)).astype(np.uint32)
        full = np.bincount(cell // k, minlength=n) == k
        todo = todo[~full[todo]]
        t *= 2
    return out


def _agree(left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that agree in at least that many coordinates."""
    found, step = [], max(1, (1 << 22) // max(1, right.size))
    for a in range(0, len(left), step):
        x, y = np.nonzero((left[a : a + step, None, :] == right[None, :, :]).sum(2, dtype=np.int16) >= least)
        found.append((x + a, y))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2  # type: ignore[return-value]


def _promising(settings: Settings):
    least = int(np.ceil((settings.similarity - settings.slack) * settings.coordinates - 1e-9))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in by_groups(batches, ["band", "key", "i", "j"]):
            ids, side = batch.column("id").to_numpy(), batch.column("side").to_numpy()
            signature = np.frombuffer(flat(batch.column("signature"))[0].tobytes(), np.uint32).reshape(batch.num_rows, -1)
            found = []
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a < 2:
                    continue
                order = a + np.argsort(ids[a:b], kind="stable")
                if side[a:b].any():
                    left, right = order[side[order] == 0], order[side[order] == 1]
                    x, y = _agree(signature[left], signature[right], least)
                    x, y = left[x], right[y]
                else:
                    x, y = _agree(signature[order], signature[order], least)
                    x, y = order[x[x < y]], order[y[x < y]]
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

    return meet


def linked(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, split: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the n rows whose (weighted) Jaccard similarity is at least ``least``; with ``split`` only those of a
    row before it and one from it on. Elements are distinct in a row. Weights beyond 1 count as so many
    elements: element e of weight 3 is (e, 0), (e, 1) and (e, 2)."""
    if (weight > 1).any():
        times = weight.astype(np.int64)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, element = np.repeat(row, times), mix(np.repeat(element, times) + mix(nth.astype(np.uint64)) * (nth > 0))
    total = np.bincount(row, minlength=n)
    ids, at, often = np.unique(element, return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    shared = often[at] > 1
    row, column = row[shared], number[at[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (slice(0, split), slice(split, n)) if split else (slice(0, n), slice(0, n))
    both = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
    width = max(256, (1 << 23) // max(n, 1))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [a, a + width])
        part = np.zeros((n, width), np.float32)
        part[row[i:j], column[i:j] - a] = 1
        both += part[left] @ part[right].T
    every = total[left][:, None] + total[right][None, :] - both
    x, y = np.nonzero((both >= (least - 1e-7) * every) & (both > 0))
    exact = both[x, y].astype(np.float64) >= least * every[x, y].astype(np.float64) - 1e-9
    x, y = x[exact] + left.start, y[exact] + right.start
    return x[x < y], y[x < y]


def near_duplicates(df: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, class_id (smallest doc_id that it hangs together with by links of at
    least ``similarity``), kept (class_id = doc_id; of rows with that doc_id all), text_hash (xxhash64 of the text, which
    tells rows of one doc_id apart). The result is a table of ``cut``."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    k = settings.coordinates

    def weigh(count: np.ndarray) -> np.ndarray:
        return count.astype(np.float64) if settings.weighted else np.ones(len(count))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            n = batch.num_rows
            words = Words(*flat(batch.column("text")), BLANKS, lanes=2)
            row, run, count = shingles(words, settings.words)
            weight = weigh(count)
            signature = signatures(row, run, weight, n, k)
            has = np.bincount(row, minlength=n) > 0
            whole_set = np.zeros((n, 2), np.uint64)
            for lane, (r, x, c) in enumerate(((row, run, count), shingles(words, settings.words, 1))):
                at = np.searchsorted(r, np.flatnonzero(has))
                if len(at):  # the sum of the members' scattered hashes, a lane of its own for each half
                    whole_set[has, lane] = np.add.reduceat(mix(x + weigh(c).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), lane), at)
            band = np.zeros((n, settings.bands), np.uint64)
            for j in range(settings.rows):
                band = mix(band + signature[:, j :: settings.rows][:, : settings.bands].astype(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, settings.bands, dtype=np.int32)), pa.array(band.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(np.diff(flat(batch.column("text"))[1])), pa.array(whole_set[:, 0].view(np.int64)), pa.array(whole_set[:, 1].view(np.int64)), pa.array(has),
                 pa.array([x.tobytes() for x in signature], pa.binary()), lists],
                names=["id", "h", "size", "s1", "s2", "has", "signature", "bands"],
            )

    signed = docs.mapInArrow(lean(sign), "id long, h long, size long, s1 long, s2 long, has boolean, signature binary, bands array<long>")
    signed = cut(signed, "signatures")
    taking = signed.where("has AND id IS NOT NULL")
    # A class holds all texts of one set. Its signature is any of theirs: they are equal. It is a node, named by its smallest
    # id, or by its hash where two classes have the same smallest id (rows that share a doc_id).
    classes = taking.groupBy("s1", "s2").agg(F.min(F.struct("id", "h", "size")).alias("x"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = cut(classes.select("s1", "s2", "x.*", "signature", "bands"), "classes")
    twice = classes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("twice"))
    twice = cut(twice, "twice")
    nodes = classes.join(twice, "id", "left").withColumn("node", F.when(F.col("twice"), F.col("s1")).otherwise(F.col("id")))
    narrow = nodes.select("node", "id", "h", "size", "s1", "s2")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(members: DataFrame, keys: list[str]) -> DataFrame:
        return members.repartition(tasks, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")

    bands = nodes.select(F.col("node").alias("id"), F.posexplode("bands").alias("band", "key"))
    several = bands.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high"))
    several = several.where("size > 1 AND low < high").select("band", "key", "size")
    members = in_blocks(bands.join(several, ["band", "key"]), ["band", "key"], "id", "size", settings.block)
    members = members.join(nodes.select(F.col("node").alias("id"), "signature"), "id").select("band", "key", "i", "j", "side", "id", "signature")
    promising = dealt(members, ["band", "key"]).mapInArrow(lean(_promising(settings)), "a long, b long").where("a < b").distinct()
    found = components(promising)
    group = found

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in by_groups(batches, ["component", "i", "j"], 256):
            ids, side = batch.column("id").to_numpy(), batch.column("side").to_numpy()
            for a, b in zip(edges[:-1], edges[1:]):
                order = a + np.lexsort((ids[a:b], side[a:b]))
                row, run, count = shingles(Words(*flat(batch.column("text").take(pa.array(order))), BLANKS), settings.words)
                x, y = linked(row, run, weigh(count), b - a, int((side[a:b] == 0).sum()) % (b - a), settings.similarity)
                own = ids[order]
                rank = np.argsort(own, kind="stable")
                place = np.empty(b - a, np.int64)
                place[rank] = np.arange(b - a)
                top = roots(b - a, place[x], place[y])
                far = np.flatnonzero(top != np.arange(b - a))
                yield pa.RecordBatch.from_arrays([pa.array(own[rank][top[far]]), pa.array(own[rank][far])], names=["a", "b"])

    group = group.select(F.col("id").alias("node"), "component").join(narrow, "node").select("node", "component", "id", "h", "size")
    weight = F.greatest(F.count("*"), F.ceil(F.sum("size") * settings.block / settings.block_bytes)).alias("weight")
    group = group.join(group.groupBy("component").agg(weight), "component").select("node", "component", "id", "h", "weight")
    group = cut(group, "groups")
    # Only texts of groups travel, repeated rows once a task; the join finds them dealt by its keys.
    texts = sieve(docs, ["id", "h"], group).dropDuplicates(["id", "h"]).join(group, ["id", "h"])
    texts = texts.select("component", F.col("node").alias("id"), "text", "weight")
    texts = dealt(in_blocks(texts, ["component"], "id", "weight", settings.block).select("component", "i", "j", "side", "id", "text"), ["component"])
    component = components(texts.mapInArrow(lean(compare), "a long, b long").where("a < b"))
    linked_nodes = component.select(F.col("id").alias("node"), "component").join(narrow.select("node", "id", "s1", "s2"), "node")
    least = linked_nodes.groupBy("component").agg(F.min("id").alias("least"))
    joined = linked_nodes.join(least, "component").select("s1", "s2", "least")
    alone = classes.select("s1", "s2", "id").join(joined, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("least", "id").alias("class_id"))
    out = taking.select("id", "h", "s1", "s2").join(alone, ["s1", "s2"]).select("id", "h", "class_id")
    rest = signed.where("NOT has OR id IS NULL").select("id", "h", F.col("id").alias("class_id"))
    out = out.unionByName(rest).select(F.col("id").alias("doc_id"), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"), F.col("h").alias("text_hash"))
    out = cut(out, "copies")
    discard(signed, classes, twice, found, group, component)
    return out
