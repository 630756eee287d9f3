"""Byte-level BPE as a monoid: a long text is halved down to leaves, leaves are encoded on their own,
and neighbours are joined up the tree by encoding a window around the seam again. The window grows on
either side until the tokens outside it provably stay as they are:

* At a *safe cut* every match of the pattern ends whatever stands on the other side (for example
  between a word and the blank after it), so what lies beyond it is encoded the same in any context.
* Inside one long match (a run of letters with no safe cut) tokens are merged by rank alone; there a
  sequence of tokens is the encoding of its bytes if and only if each two neighbours, encoded
  together, come out as the same two tokens. The window of tokens doubles until both of its edges pass.

Decoding turns leaves of ids into bytes and concatenates them up the tree.

Defined cases: a null text is an empty one; an empty text has no ids, and decodes to no bytes. All
other columns pass through unchanged; an output column replaces one of the same name."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framesift.llm.runtime import flat, lean, pieces, ship

#: Fixed choice: characters in a leaf; the result doesn't depend on it.
LEAF_CHARS = 4096
#: From this many characters on a window that is one match is joined token by token.
LONG_WINDOW = 2048

_SAFE = re.compile(
    r"(?<=[^\s\x1c-\x1f\x85\u180e\u200b\ufeff])(?=[ \t\n\r])"  # no match goes from a non-blank to a blank
    r"|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])"  # or from a letter to anything else
    r"|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])"  # or from a digit to anything else
    r"|(?<=[ \t\n\r])(?=[ \t\n\r][A-Za-z0-9])"  # and a run of blanks gives up its last one
)
_ONE_MATCH = re.compile(r"[ \t\n\r]+| ?[!-&(-/:-@\[-`{-~]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeEncoder:
    """Encodes and decodes by tree reduction. ``leaf`` is the size of a leaf in characters."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS):
        self.encoding = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = max(2, leaf)
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length_of = np.array([len(x) for x in self.bytes_of], np.int64)
        self.tokens = pa.array(self.bytes_of, pa.binary())
        self._pairs: dict[tuple[int, int], bool] = {}

    # -- encoding ---------------------------------------------------------------------------------
    def flat_encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        n = len(text)
        if n <= self.leaf:
            return self.flat_encode(text)
        parts = 1 << int(np.ceil(np.log2(n / self.leaf)))
        ends = [n * (k + 1) // parts for k in range(parts)]
        level = [(a, b, self.flat_encode(text[a:b])) for a, b in zip([0, *ends[:-1]], ends)]
        while len(level) > 1:
            level = [self._join(text, level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0][2]

    def _join(self, text: str, left: tuple, right: tuple) -> tuple:
        lo, mid, ids = left
        _, hi, more = right
        if not len(ids) or not len(more):
            return lo, hi, np.concatenate([ids, more])
        a, b = self._cut_before(text, lo, mid), self._cut_after(text, mid, hi)
        head, tail = text[a:mid], text[mid:b]
        k = len(ids) - self._tokens_in(ids[::-1], head)
        m = self._tokens_in(more, tail)
        if b - a > LONG_WINDOW and self._is_one_match(head + tail):
            seam = self._join_tokens(ids[k:].tolist(), more[:m].tolist())
        else:
            seam = self.flat_encode(head + tail)
        return lo, hi, np.concatenate([ids[:k], np.asarray(seam, np.uint32), more[m:]])

    @staticmethod
    def _cut_before(text: str, lo: int, mid: int) -> int:
        width = 32
        while True:
            at = max(lo, mid - width)
            found = -1
            for m in _SAFE.finditer(text, at, mid):
                if m.start() > lo:
                    found = m.start()
            if found >= 0:
                return found
            if at == lo:
                return lo
            width *= 4

    @staticmethod
    def _cut_after(text: str, mid: int, hi: int) -> int:
        m = _SAFE.search(text, mid + 1, hi)
        return m.start() if m else hi

    def _tokens_in(self, ids: np.ndarray, text: str) -> int:
        """How many tokens from the front of ``ids`` make up ``text``."""
        size, n = len(text.encode("utf-8", "replace")), 64
        while True:
            sums = np.cumsum(self.length_of[ids[:n]])
            if len(sums) >= len(ids) or sums[-1] >= size:
                return int(np.searchsorted(sums, size)) + 1
            n *= 8

    @staticmethod
    def _is_one_match(window: str) -> bool:
        run = window[1:] if window[:1] == " " else window
        return run.isalpha() or run.isdecimal() or bool(_ONE_MATCH.fullmatch(window))

    def _stay(self, a: int, b: int) -> bool:
        """Whether two neighbours stay two tokens when they are encoded together."""
        if (found := self._pairs.get((a, b))) is None:
            if len(self._pairs) > 100_000:
                self._pairs.clear()
            found = self._pairs[a, b] = self._piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def _piece(self, piece: bytes) -> list[int]:
        return self.encoding._encode_single_piece(piece)

    def _join_tokens(self, x: list[int], y: list[int]) -> list[int]:
        width = 4
        while True:
            a, b = max(0, len(x) - width), min(len(y), width)
            seam = self._piece(b"".join(map(self.bytes_of.__getitem__, x[a:] + y[:b])))
            if (a == 0 or self._stay(x[a - 1], seam[0])) and (b == len(y) or self._stay(seam[-1], y[b])):
                return x[:a] + seam + y[b:]
            width *= 2

    # -- decoding ---------------------------------------------------------------------------------
    def decode(self, ids: np.ndarray, leaf: int = 1 << 16) -> bytes:
        level = [self._leaf_bytes(ids[k : k + leaf]) for k in range(0, len(ids), leaf)] or [b""]
        while len(level) > 1:
            level = [level[k] + level[k + 1] if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0]

    def _leaf_bytes(self, ids: np.ndarray) -> bytes:
        return flat(self.tokens.take(pa.array(ids)))[0].tobytes()


#: One encoder a worker and vocabulary; its size is the vocabulary's.
_encoders: dict[tuple, TreeEncoder] = {}
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoder(shared, leaf: int) -> TreeEncoder:
    key = (shared.id if hasattr(shared, "id") else id(shared), leaf)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TreeEncoder(*shared.value, leaf)
    return _encoders[key]


def _put(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names, columns = list(batch.schema.names), list(batch.columns)
    if name in names:
        columns[names.index(name)] = column
    else:
        names, columns = [*names, name], [*columns, column]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    fields = [f if f.name != name else T.StructField(name, kind) for f in schema.fields]
    return T.StructType(fields if name in schema.names else [*fields, T.StructField(name, kind)])


class Bpe:
    """The operator for one vocabulary. The vocabulary (a file of fixed size) is read on the driver and
    broadcast. ``encode`` and ``decode`` add a column of their own; ``both`` fuses them into one pass."""

    def __init__(self, spark, path: str, pattern: str, leaf: int = LEAF_CHARS):
        ship(spark)
        self.shared = spark.sparkContext.broadcast((read_ranks(path), pattern))
        self.leaf = leaf

    def encoding_step(self, text: str, ids: str) -> Step:
        shared, leaf = self.shared, self.leaf

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = _encoder(shared, leaf)
            for batch in pieces(batches, text):
                rows = [tree.encode(x) if x else np.zeros(0, np.uint32) for x in batch.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, rows)])
                values = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
                yield _put(batch, ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)))

        return step

    def decoding_step(self, ids: str, out: str) -> Step:
        shared, leaf = self.shared, self.leaf

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = _encoder(shared, leaf)
            for batch in batches:
                column = batch.column(ids)
                values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                yield _put(batch, out, pa.array([tree.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary()))

        return step

    def encode(self, df: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """``df`` with the token ids of ``text``, an array of int."""
        schema = _with(df.schema, ids, T.ArrayType(T.IntegerType()))
        return df.mapInArrow(lean(self.encoding_step(text, ids)), schema)

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """``df`` with the bytes that ``ids`` stand for. Null ids have no bytes."""
        return df.mapInArrow(lean(self.decoding_step(ids, out)), _with(df.schema, out, T.BinaryType()))

    def both(self, df: DataFrame, then: Step, schema: T.StructType, text: str = "text") -> DataFrame:
        """Encode, decode and ``then`` in one pass over the rows; ``then`` sees ``ids`` and ``decoded``."""
        encode, decode = self.encoding_step(text, "ids"), self.decoding_step("ids", "decoded")
        return df.mapInArrow(lean(lambda batches: then(decode(encode(batches)))), schema)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded bytes."""
    decimal: pa.Array | None = None
    for batch in batches:
        column = batch.column("ids")
        values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        if decimal is None or (len(values) and len(decimal) <= values.max()):
            decimal = pa.array([b"%d " % k for k in range(1 << max(16, int(values.max(initial=0)).bit_length()))], pa.binary())
        data, at = flat(decimal.take(pa.array(values)))
        text = memoryview(np.ascontiguousarray(data))
        sha = [hashlib.sha256(text[at[a] : max(at[a], at[b] - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
        back = [hashlib.sha256(x).hexdigest() for x in batch.column("decoded").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sha, pa.string()), pa.array(back, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


DIGESTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])
