"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index,
votes weighted by nearness, calibrated to probabilities, with the nearest examples as evidence.

Terms are words (runs of ASCII letters and digits and of all other characters from U+0080 on, in ASCII lower case). From a
bounded sample of labelled rows (see ``Settings``) come the terms, their IDF, the examples, and an isotonic calibration
on other rows, a quarter by hash, in natural proportions. All terms whose share of the rows differs between the labels by
at least ``significance`` standard errors are indexed, whichever label they speak for and however many they are; weights
are plain TF-IDF, (1 + log count) * IDF, and vectors have length 1.

The index is an inverted one: for each term its postings (example, weight), and for each term and block of ``block``
examples the largest weight. For a text the blocks are visited in the order of their upper bounds, until the bound is less
than the k-th best cosine: the k nearest are exact (ties, to 12 digits, to the smaller doc_id). Blocks hold examples that
share their heaviest term, so that bounds tell blocks apart.

Scoring reads whole texts and never collects; what it broadcasts is of a size that the settings bound. Defined cases: null
and empty texts, and texts without any indexed term, get the calibrated score of no vote at all; where the sample has not
rows of both labels, every score is the share of toxic rows among all drawn (0 without any); repeated rows each get their
row; of labelled rows that share a doc_id the larger label counts; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.runtime import cut, discard, flat, lean, pieces, ship
from framesift.llm.wordbytes import Words, mix, separators, stretches

#: Bytes of text that are looked at together.
SLICE = 1 << 19
BLANK = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Settings:
    """The bounds of what is learned from: ``sample`` labelled rows of each label choose terms and IDF, the
    ``examples`` of each label among them are indexed, ``calibration`` other rows calibrate."""

    sample: int = 2048
    examples: int = 1024
    calibration: int = 2048
    significance: float = 3.0
    least_rows: int = 5
    block: int = 64
    k: int = 15


def terms_of(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and counts, sorted by row and term. Terms are hashes, or with ``known`` (sorted hashes) places
    among those; others are left out."""
    rows, terms, counts = [], [], []
    for part, ends in stretches(data, offsets, BLANK, SLICE):
        words = Words(_LOWER[part], ends, BLANK)
        row, term = words.doc, words.hash
        if known is not None:
            at = np.searchsorted(known, term)
            at[at == len(known)] = 0
            has = np.flatnonzero(known[at] == term) if len(known) else np.zeros(0, np.int64)
            row, term = row[has], at[has].astype(np.uint64)
        order = np.lexsort((term, row))
        row, term = row[order], term[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
        at = np.flatnonzero(new)
        rows.append(row[at]), terms.append(term[at]), counts.append(np.diff(np.append(at, len(row))))
    row, term, count = (np.concatenate(x) for x in (rows, terms, counts))
    if len(rows) > 1:  # one long text in stretches
        term, at = np.unique(term, return_inverse=True)
        row, count = np.zeros(len(term), np.int64), np.bincount(at, count, len(term)).astype(np.int64)
    return row, term, count


class Index:
    """Block-max inverted index. Postings stand by term and, within a term, by example: ``at[t, b]`` is where those of
    term t in block b begin, and ``most[t, b]`` their largest weight."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, labels: np.ndarray, ids: np.ndarray, block: int, k: int):
        self.labels, self.ids, self.k, self.block = labels, ids, k, block
        self.blocks = -(-len(ids) // block)
        order = np.lexsort((rows, terms))
        self.example, self.weight = rows[order], weights[order]
        cell = terms[order] * self.blocks + self.example // block
        self.at = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))
        most = np.zeros(n_terms * self.blocks)
        np.maximum.at(most, cell, self.weight)
        self.most = most.reshape(n_terms, self.blocks)

    def cosines(self, blocks: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Block x example in it: exact cosines, from the postings of ``terms`` in ``blocks``."""
        cell = (terms[:, None] * self.blocks + blocks[None, :]).ravel()
        a, n = self.at[cell], self.at[cell + 1] - self.at[cell]
        place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        slot = np.repeat(np.tile(np.arange(len(blocks)), len(terms)), n) * self.block + self.example[place] % self.block
        return np.bincount(slot, np.repeat(np.repeat(values, len(blocks)), n) * self.weight[place], len(blocks) * self.block)

    def nearest(self, terms: np.ndarray, values: np.ndarray, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines of the k nearest with a cosine above 0, best first. ``step`` blocks are taken
        at once."""
        ids, best, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        if not len(terms):
            return ids, best
        bound = values @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order, at = order[bound[order] > 0], 0
        while at < len(order):
            now = order[at : at + step]
            now = now[bound[now] >= kth - 1e-9]  # the others can't hold one of the k nearest
            if not len(now):
                break
            cos = self.cosines(now, terms, values)
            near = np.flatnonzero((cos > 0) & (cos >= kth - 1e-9))
            ids, best = np.concatenate([ids, now[near // self.block] * self.block + near % self.block]), np.concatenate([best, cos[near]])
            pick = np.lexsort((self.ids[ids], -np.round(best, 12)))[: self.k]
            ids, best = ids[pick], best[pick]
            kth = float(best[-1]) if len(best) == self.k else 0.0
            at, step = at + step, 2 * step
        return ids, best

    def vote(self, terms: np.ndarray, values: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The share of toxic examples among the nearest, weighted by the square of the cosine; -1 without any."""
        ids, cos = self.nearest(terms, values)
        w = cos**2
        return (float(w @ self.labels[ids] / w.sum()) if len(ids) else -1.0), ids, cos


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of the terms
    idf: np.ndarray
    index: Index | None
    steps: np.ndarray  # calibration: votes ...
    values: np.ndarray  # ... and the probability from there on
    prior: float

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[terms]
        return v / np.linalg.norm(v) if len(v) else v

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if self.index is None:
            return self.prior, np.zeros(0, np.int64), np.zeros(0)
        vote, ids, cos = self.index.vote(terms, self.unit(terms, counts))
        return float(np.interp(vote, self.steps, self.values)), ids, cos


def isotonic(x: np.ndarray, y: np.ndarray, prior: float, weight: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps through (x, y) by pooling neighbours; each pool is drawn to the prior a little."""
    if not len(x):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    at, inverse = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []
    for a, s, n in zip(at, np.bincount(inverse, y), np.bincount(inverse)):
        pools.append([a, a, s, n])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, hi, s2, n2 = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + s2, pools[-1][3] + n2]
    xs, ys = [], []
    for lo, hi, s, n in pools:
        p = (s + prior * weight * 0.5) / (n + weight * 0.5)
        xs += [lo, hi] if hi > lo else [lo]
        ys += [p, p] if hi > lo else [p]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings, doc_id: str, text: str, label: str) -> DataFrame:
    """id, y, part (0: terms and examples, 1: calibration) and text of the labelled rows that are learned from."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(29), "id")
    apart = F.pmod(F.xxhash64(F.lit(37), "id"), F.lit(4)) == 0
    ids = [known.where((F.col("y") == y) & ~apart).orderBy(order, "id").limit(settings.sample).withColumn("part", F.lit(0)) for y in (0, 1)]
    ids.append(known.where(apart).orderBy(order, "id").limit(settings.calibration).withColumn("part", F.lit(1)))
    ids = ids[0].unionByName(ids[1]).unionByName(ids[2])
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id", "y", "part").agg(F.min("text").alias("text"))  # one row an id


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the texts in ``docs`` of a bounded sample of ``labels``, drawn by a hash of ``doc_id``. Rows
    whose label is not 0 or 1 teach nothing. Only the drawn ids meet the texts: of at most 2 * ``sample`` +
    ``calibration`` labels, they are broadcast, and texts aren't shuffled. The driver gets the terms that are indexed
    and, of the sample's rows, the counts of these."""
    ship(docs.sparkSession)
    drawn = cut(_sample(docs, labels, settings, doc_id, text, label), "sample")
    shares = {(r["part"], r["y"]): r["n"] for r in drawn.groupBy("part", "y").agg(F.count("*").alias("n")).collect()}
    n = [shares.get((0, y), 0) for y in (0, 1)]
    natural = [shares.get((1, y), 0) for y in (0, 1)]
    prior = natural[1] / sum(natural) if sum(natural) else (n[1] / sum(n) if sum(n) else 0.0)
    if not all(n):
        every = [a + b for a, b in zip(n, natural)]
        discard(drawn)
        return Model(np.zeros(0, np.uint64), np.zeros(0), None, np.zeros(0), np.zeros(0), every[1] / sum(every) if sum(every) else 0.0)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE):
            r, t, _ = terms_of(*flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(batch.column("y").to_numpy()[r])], names=["term", "y"])

    has = drawn.where("part = 0").select("y", "text").mapInArrow(distinct, "term long, y int").groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("n1"))
    share = F.col("n") / sum(n)
    z = (F.col("n1") / n[1] - (F.col("n") - F.col("n1")) / n[0]) / F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    got = has.where((F.col("n") >= min(settings.least_rows, sum(n))) & (F.abs(z) >= settings.significance)).select("term", "n").toArrow()
    known, often = got["term"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(known)
    known, often = known[order], often[order]
    model = Model(known, np.log((sum(n) + 1) / (often + 1)) + 1e-3, None, np.zeros(0), np.zeros(0), prior)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE):
            r, t, c = terms_of(*flat(batch.column("text")), known)
            ends = pa.array(np.searchsorted(r, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (t, c)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("id", "y", "part")), *lists], names=["id", "y", "part", "terms", "counts"])

    rows = drawn.mapInArrow(count, "id long, y int, part int, terms array<int>, counts array<int>").toArrow().sort_by("id").combine_chunks()
    discard(drawn)
    ids, y, part = (rows[c].to_numpy() for c in ("id", "y", "part"))
    ends = rows["terms"].combine_chunks().offsets.to_numpy()
    terms, counts = (rows[c].combine_chunks().values.to_numpy().astype(np.int64) for c in ("terms", "counts"))
    vectors = [(terms[a:b], model.unit(terms[a:b], counts[a:b])) for a, b in zip(ends[:-1], ends[1:])]

    by = _spread(ids)
    chosen = [np.flatnonzero((part == 0) & (y == v)) for v in (0, 1)]
    indexed = np.concatenate([c[np.argsort(by[c], kind="stable")[: settings.examples]] for c in chosen])
    heaviest = np.array([vectors[i][0][np.argmax(vectors[i][1])] if len(vectors[i][0]) else -1 for i in indexed], np.int64)
    indexed = indexed[np.lexsort((ids[indexed], heaviest, y[indexed]))]  # alike examples share blocks
    model.index = Index(
        np.repeat(np.arange(len(indexed)), [len(vectors[i][0]) for i in indexed]), np.concatenate([vectors[i][0] for i in indexed]),
        np.concatenate([vectors[i][1] for i in indexed]), len(known), y[indexed].astype(np.float64), ids[indexed], settings.block, settings.k,
    )
    rest = np.flatnonzero(part == 1)
    votes = np.array([model.index.vote(*vectors[i])[0] for i in rest])
    model.steps, model.values = isotonic(votes, y[rest].astype(float), prior)
    return model


def _spread(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64) + np.uint64(29))


SCORED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))),
])


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", evidence: int = 3) -> DataFrame:
    """Per row of ``df``: calibrated probability of the label, and the nearest examples. All other columns
    of ``df`` are dropped; see ``score_with`` to keep them."""
    return score_with(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), model, "text", evidence).select("doc_id", "score", "evidence")


def score_with(df: DataFrame, model: Model, text: str = "text", evidence: int = 3) -> DataFrame:
    """``df`` with ``score`` and ``evidence`` (replacing columns of these names)."""
    spark = df.sparkSession
    ship(spark)
    df = df.drop("score", "evidence")
    shared = spark.sparkContext.broadcast(model)  # of a size that the settings bound

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, text, SLICE):
            r, t, c = terms_of(*flat(batch.column(batch.schema.get_field_index(text))), m.known)
            t, ends = t.astype(np.int64), np.searchsorted(r, np.arange(batch.num_rows + 1))
            scores, found = np.empty(batch.num_rows), []
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                scores[k], ids, cos = m.score(t[a:b], c[a:b])
                found.append([{"doc_id": int(m.index.ids[i]), "toxic": int(m.index.labels[i]), "cosine": float(x)} for i, x in zip(ids[:evidence], cos[:evidence])])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(found, kind)], names=[*batch.schema.names, "score", "evidence"])

    return df.mapInArrow(lean(judge), T.StructType([*df.schema.fields, *SCORED.fields[1:]]))
