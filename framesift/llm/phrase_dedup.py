"""Substring dedup by repeated-phrase automata.

A phrase is ``width`` consecutive words. A word goes if a phrase that covers it also starts in a document
with a smaller doc_id. Rows are dealt to shards by a hash of doc_id and text (a shard is a bounded number of
bytes, a document is never split), and three passes go over the shards:

1. Anchors. The smallest hash of a run of ``anchor`` words within each phrase is the phrase's anchor, so
   equal phrases have equal anchors, and there are far fewer anchors than phrases. Each shard sends its
   distinct anchors to buckets by hash, and learns which of them other shards have too.
2. Confirmation. Only phrases under a recurring anchor are sent on, as 128-bit hashes with the shard's
   smallest doc_id and a place in the shard: one a shard however often it recurs there. A bucket returns to each
   shard the places of phrases that some document of the shard repeats, with the smallest doc_id over all documents.
3. Location. Each shard compiles the words at the places it was told to an Aho-Corasick automaton and streams all its
   documents through it: the automaton's hits are the phrases' occurrences, and each is judged by its doc_id.

What a shard or bucket holds is bounded by the parameters whatever recurs: a phrase in a third of all
documents is one entry a shard. No text but the documents themselves is shuffled. What a shard sends to a bucket is one
row; a shard has as many rows as buckets, or as keys if these are fewer, so rows grow with the keys at most.

Words are [^\\x20\\x09-\\x0D]+, and equal if 128 bits of hash are. Defined cases: null text has no words; documents of
null doc_id take no part and keep all words (they are not shuffled); rows that share a doc_id are one document for the
rule, each its own row; empty tables give no rows. Other columns pass through, except those named like the output, which
are replaced."""

from __future__ import annotations

from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.runtime import flat, lean, pieces, ship
from framesift.llm.wordbytes import BLANKS, Words, runs, whole

#: The shard of a row, a column beside those of the documents.
SHARD = "__phrase_shard"


class Shard:
    """Words of a shard's documents, in an order that only the documents decide: places mean the same in every pass."""

    def __init__(self, table: pa.Table, text: str, doc_id: str, width: int):
        self.table = table.take(pc.sort_indices(table.select([doc_id, text]), [(doc_id, "ascending"), (text, "ascending")]))
        self.data, self.offsets = flat(self.table.column(text).combine_chunks())
        self.words = Words(self.data, self.offsets, BLANKS, lanes=2)
        self.ids = self.table.column(doc_id).combine_chunks().cast(pa.int64()).to_numpy(zero_copy_only=False)
        self.width = width
        self.ok = whole(self.words.first, width)  # which phrases lie in one document
        self.doc = self.ids[self.words.doc[: len(self.ok)]]  # doc_id by phrase

    def anchors(self, size: int) -> np.ndarray:
        """The anchor of each phrase."""
        grams = runs(self.words.hash, size, seed=1)
        n = len(self.ok)
        out = grams[:n].copy()
        for k in range(1, self.width - size + 1):
            np.minimum(out, grams[k : k + n], out=out)
        return out

    def phrases(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for the phrases at ``at``, one half from each lane of the words."""
        return runs(self.words.hash, self.width, seed=2)[at], runs(self.words.more, self.width, seed=3)[at]

    def numbers(self, places: np.ndarray) -> np.ndarray:
        """Numbers from 1 on for the words of the phrases at ``places``, wherever they stand; 0 for other words."""
        inside = np.zeros(len(self.words.hash) + 1, np.int64)
        np.add.at(inside, places, 1)
        np.add.at(inside, places + self.width, -1)
        used = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        known, at = np.unique(self.words.hash[used], return_index=True)
        spot = np.searchsorted(known, self.words.hash)
        spot[spot == len(known)] = 0
        same = (known[spot] == self.words.hash) & (self.words.more[used[at]][spot] == self.words.more)
        return np.where(same, spot + 1, 0)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the groups of sorted keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _repeated(anchor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors, and whether more than one doc_id has them."""
    order = np.argsort(anchor, kind="stable")
    anchor, doc = anchor[order], doc[order]
    at = _groups(anchor)
    if not len(at):
        return anchor, np.zeros(0, bool)
    return anchor[at], np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted 64-bit keys (equal stretches of the key space), and where each begins and ends."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = _groups(bucket)
    return bucket[at].astype(np.int32), np.append(at, len(keys))


def _blobs(rows: list[dict], names: list[str]) -> pa.Table:
    """A table of ints and of arrays as bytes."""
    kinds = [pa.int32() if n in ("bucket", "shard") else pa.binary() for n in names]
    return pa.table({n: pa.array([r[n] if k == pa.int32() else r[n].tobytes() for r in rows], k) for n, k in zip(names, kinds)})


def _joined(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


class Automaton:
    """Aho-Corasick over words. A word is spelled in two or more letters of an alphabet of its place, so that no node has
    many children and no match begins within a word."""

    def __init__(self, numbers: np.ndarray, width: int):
        """``numbers``: the words of a run of documents, from 1 on, 0 for a word that no phrase has."""
        most, self.width = int(numbers.max(initial=0)) + 1, width
        self.each = 2 if most <= 1 << 16 else 3
        alphabet = 1
        while alphabet**self.each < most:
            alphabet += 1
        letters, rest = np.empty((len(numbers), self.each), np.uint32), numbers.astype(np.int64)
        for k in range(self.each):
            letters[:, k] = rest % alphabet + 256 + (k << 11)
            rest //= alphabet
        letters[numbers == 0] = 1
        self.text = letters.astype("<u4").tobytes().decode("utf-32-le")
        self.made = ahocorasick.Automaton(ahocorasick.STORE_INTS)

    def compile(self, places: np.ndarray) -> None:
        """Take as phrases the words from each of ``places`` on, by number."""
        size, add, text = self.width * self.each, self.made.add_word, self.text
        for k, a in enumerate((places * self.each).tolist()):
            add(text[a : a + size], k)
        if len(places):
            self.made.make_automaton()

    def occurrences(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all phrases between the words a and b: the first word, and the phrase's number."""
        found = np.array(list(self.made.iter(self.text, a * self.each, b * self.each)), np.int64).reshape(-1, 2)
        return (found[:, 0] + 1) // self.each - self.width, found[:, 1]


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 13, anchor: int = 5,
                   shard_bytes: int = 2 << 20, bucket_bytes: int = 16 << 20, rest: bool = False) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed``, ``kept`` (kept words joined by a space), ``removed`` (stretches
    of words, first and last) and, if wanted, ``rest``: the text as it was, line breaks and all, less the removed
    stretches, each from its first word up to the next word that stays."""
    spark = df.sparkSession
    ship(spark)
    df = df.drop("n_words", "n_removed", "kept", "removed", SHARD, *(["rest"] if rest else []))
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards, buckets = max(1, -(-int(total) // shard_bytes)), max(1, -(-int(total) // bucket_bytes))
    parts = max(shards // 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The three passes read this same exchange; Spark keeps one copy of it.
    docs = df.where(F.col(doc_id).isNotNull()).withColumn(SHARD, F.pmod(F.xxhash64(doc_id, text), F.lit(shards)).cast("int")).repartition(parts, SHARD)

    def send_anchors(table: pa.Table) -> pa.Table:
        s = Shard(table, text, doc_id, width)
        keys = np.unique(s.anchors(anchor)[s.ok]) if len(s.ok) else np.zeros(0, np.uint64)
        where, at = _cuts(keys, buckets)
        shard = table.column(SHARD)[0].as_py()
        return _blobs([{"bucket": b, "shard": shard, "keys": keys[i:j]} for b, i, j in zip(where, at[:-1], at[1:])], ["bucket", "shard", "keys"])

    def shared_anchors(table: pa.Table) -> pa.Table:
        own = _joined(table.column("keys"), np.uint64)
        every = np.sort(np.concatenate(own))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        rows = [{"shard": s, "keys": found} for s, k in zip(table.column("shard").to_pylist(), own) if len(found := k[_within(k, twice)])]
        return _blobs(rows, ["shard", "keys"])

    def send_phrases(table: pa.Table, known: pa.Table) -> pa.Table:
        names = ["bucket", "shard", "high", "low", "doc", "many", "place"]
        if not table.num_rows:
            return _blobs([], names)
        s = Shard(table, text, doc_id, width)
        if not len(s.ok):
            return _blobs([], names)
        keys = s.anchors(anchor)
        first = np.ones(len(keys), bool)  # of a stretch of phrases with one anchor
        first[1:] = (keys[1:] != keys[:-1]) | (s.doc[1:] != s.doc[:-1])
        here, many = _repeated(keys[s.ok & first], s.doc[s.ok & first]) if (s.ok & first).any() else (keys[:0], np.zeros(0, bool))
        recurring = np.unique(np.concatenate([here[many], *_joined(known.column("a_keys"), np.uint64)]))
        at = np.flatnonzero(s.ok & _within(keys, recurring))
        high, low = s.phrases(at)
        doc = s.doc[at]
        order = np.lexsort((low, high))
        high, low, doc = high[order], low[order], doc[order]
        g = _groups(high, low)
        if not len(g):
            return _blobs([], names)
        least, most = np.minimum.reduceat(doc, g), np.maximum.reduceat(doc, g)
        high, low, many, place = high[g], low[g], least != most, at[order][g].astype(np.int32)
        parts = dict(zip(names[2:], (high, low, least, many, place)))
        where, at = _cuts(high, buckets)
        shard = table.column(SHARD)[0].as_py()
        return _blobs([{"bucket": b, "shard": shard, **{n: x[i:j] for n, x in parts.items()}} for b, i, j in zip(where, at[:-1], at[1:])], names)

    def confirm(table: pa.Table) -> pa.Table:
        parts = {n: _joined(table.column(n), k) for n, k in (("high", np.uint64), ("low", np.uint64), ("doc", np.int64), ("many", bool), ("place", np.int32))}
        sizes = [len(x) for x in parts["high"]]
        high, low, doc, many, place = (np.concatenate(x) for x in parts.values())
        order = np.lexsort((low, high))
        g = _groups(high[order], low[order])
        size = np.diff(np.append(g, len(order)))
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(np.minimum.reduceat(doc[order], g), size)
        again = np.empty(len(order), bool)
        again[order] = np.repeat(size > 1, size)
        wanted = np.flatnonzero((again | many) & (many | (doc > first)))  # still by sender
        ends = np.searchsorted(wanted, np.cumsum([0, *sizes]))
        rows = [{"shard": s, "place": place[wanted[i:j]], "first": first[wanted[i:j]]} for s, i, j in zip(table.column("shard").to_pylist(), ends[:-1], ends[1:]) if j > i]
        return _blobs(rows, ["shard", "place", "first"])

    out_schema = T.StructType([
        *df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        *([T.StructField("rest", T.StringType())] if rest else []),
    ])
    passed = df.columns

    def located(s: Shard, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each phrase of the shard whether an earlier document has it, from the automaton's hits."""
        number = s.numbers(places)
        automaton = Automaton(number, width)
        automaton.compile(places)
        # a phrase can only stand in a stretch of at least ``width`` words that phrases have, within a document
        known = np.flatnonzero(number)
        fresh = np.ones(len(known), bool)
        fresh[1:] = (known[1:] != known[:-1] + 1) | (s.words.doc[known[1:]] != s.words.doc[known[:-1]])
        heads = known[fresh]
        tails = known[np.append(np.flatnonzero(fresh)[1:], len(known)) - 1] + 1
        out, longer = np.zeros(len(s.ok), bool), tails - heads >= width
        for x, y in zip(heads[longer].tolist(), tails[longer].tolist()):
            at, which = automaton.occurrences(x, y)
            out[at] = first[which] < s.doc[at]
        return out

    def answer(table: pa.Table, data: np.ndarray, offsets: np.ndarray, starts: dict[int, np.ndarray]) -> pa.Table:
        """``table`` with what the documents' phrases at ``starts`` (by row, words from 0) leave."""
        n_words, n_removed, kept, removed, remain = [], [], [], [], []
        raw = memoryview(np.ascontiguousarray(data))
        for d in range(table.num_rows):
            body = bytes(raw[offsets[d] : offsets[d + 1]])
            words = body.split()
            n_words.append(len(words))
            spans: list[dict] = []
            left = body
            if d in starts:
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, starts[d], 1)
                np.add.at(cover, starts[d] + width, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                spans = [{"first": x, "last": y - 1} for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
                words = list(compress(words, (~gone).tolist()))
                if rest:
                    begins = np.append(Words(np.frombuffer(body, np.uint8), np.array([0, len(body)]), BLANKS, lanes=0).start, len(body)).tolist()
                    cuts = [0, *(x for span in spans for x in (begins[span["first"]], begins[span["last"] + 1])), len(body)]
                    left = b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            remain.append(left)
            removed.append(spans)
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        table = table.select(passed)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        added = (("n_words", pa.array(n_words, pa.int64())), ("n_removed", pa.array(n_removed, pa.int64())), ("kept", pa.array(kept, pa.binary()).cast(pa.string())), ("removed", pa.array(removed, kind)))
        if rest:
            added += (("rest", pa.array(remain, pa.binary()).cast(pa.string())),)
        for name, values in added:
            table = table.append_column(name, values)
        return table

    def locate(table: pa.Table, confirmed: pa.Table) -> pa.Table:
        if not table.num_rows:
            return answer(table, np.zeros(0, np.uint8), np.zeros(1, np.int64), {})
        s = Shard(table, text, doc_id, width)
        starts: dict[int, np.ndarray] = {}
        if confirmed.num_rows:
            places, first = (np.concatenate(_joined(confirmed.column(f"a_{n}"), k)) for n, k in (("place", np.int32), ("first", np.int64)))
            at = np.flatnonzero(located(s, places.astype(np.int64), first))
            doc = s.words.doc[at]
            edges = np.flatnonzero(np.diff(doc, prepend=-1))
            starts = {int(doc[i]): at[i:j] - s.words.first[doc[i]] for i, j in zip(edges, np.append(edges[1:], len(at)))}
        return answer(s.table, s.data, s.offsets, starts)

    def untouched(batches):
        """Rows that take no part."""
        for batch in pieces(batches, text):
            yield from answer(pa.Table.from_batches([batch]), *flat(batch.column(batch.schema.get_field_index(text))), {}).combine_chunks().to_batches()

    def renamed(frame: DataFrame) -> DataFrame:
        return frame.select(*(F.col(c).alias(f"a_{c}") for c in frame.columns))

    def told(function, frame: DataFrame, schema) -> DataFrame:
        return docs.groupBy(SHARD).cogroup(renamed(frame).groupBy("a_shard")).applyInArrow(lean(function), schema)

    anchors = docs.groupBy(SHARD).applyInArrow(lean(send_anchors), "bucket int, shard int, keys binary")
    anchors = anchors.groupBy("bucket").applyInArrow(lean(shared_anchors), "shard int, keys binary")
    phrases = told(send_phrases, anchors, "bucket int, shard int, high binary, low binary, doc binary, many binary, place binary")
    confirmed = phrases.groupBy("bucket").applyInArrow(lean(confirm), "shard int, place binary, first binary")
    return told(locate, confirmed, out_schema).unionByName(df.where(F.col(doc_id).isNull()).mapInArrow(untouched, out_schema))
