"""Language ID of mixed texts: script ranges narrow a word's candidate languages, byte trigrams score the
word under each candidate, and Viterbi with a switching penalty labels spans of words.

A character's script follows from its code point. A language has the scripts that make up at least ``SCRIPT_SHARE`` of its
letters; a word with letters of scripts that some languages have costs the others ``OUTSIDE``.

The model is counts of hashed byte trigrams and of scripts per language, summed by Spark over all training rows. All
languages are learned. What reaches the driver and the tasks is at most ``CELLS`` cells a language and ``MODEL_CELLS`` in
all: with more than 64 languages trigrams share cells (their hashes are cut shorter), down to 64 cells at 131,072 languages;
more values of a language column than that are refused.

Defined cases: null text, empty text and text without a letter are ``und`` with score 0 and no spans;
a table without training rows makes every text ``und``; ties go to the first language in order; repeated
rows each get their row; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.runtime import cut, discard, flat, lean, pieces, ship
from framesift.llm.wordbytes import BLANKS, Words

CELL_BITS = 17
CELLS, MODEL_CELLS, LEAST_BITS = 1 << CELL_BITS, 1 << 23, 6
#: Fixed choices: nats to change language between two words; what a script outside the language costs.
SWITCH, OUTSIDE = 6.0, 50.0
#: A language has a script that makes up at least this share of its script-bearing letters.
SCRIPT_SHARE = 0.01
#: Bytes of text that are looked at together where languages are few; languages whose counts a task holds at once.
SLICE, HELD = 4 << 20, 64

#: Scripts by the code points of their letters, as inclusive ranges (Unicode blocks).
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2B8), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB64), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x531, 0x58F), (0xFB13, 0xFB17))),
    ("hebrew", ((0x591, 0x5F4), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC))),
    ("syriac", ((0x700, 0x74F), (0x860, 0x86F))),
    ("thaana", ((0x780, 0x7BF),)),
    ("nko", ((0x7C0, 0x7FF),)),
    ("devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)),
    ("gujarati", ((0xA80, 0xAFF),)),
    ("odia", ((0xB00, 0xB7F),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)),
    ("malayalam", ((0xD00, 0xD7F),)),
    ("sinhala", ((0xD80, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("lao", ((0xE80, 0xEFF),)),
    ("tibetan", ((0xF00, 0xFFF),)),
    ("myanmar", ((0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F))),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF))),
    ("ethiopic", ((0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F))),
    ("cherokee", ((0x13A0, 0x13FF), (0xAB70, 0xABBF))),
    ("khmer", ((0x1780, 0x17FF), (0x19E0, 0x19FF))),
    ("mongolian", ((0x1800, 0x18AF),)),
    ("kana", ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D), (0x1B000, 0x1B16F))),
    ("bopomofo", ((0x3105, 0x312F), (0x31A0, 0x31BF))),
    ("han", ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
    ("yi", ((0xA000, 0xA4CF),)),
)
_RANGES = sorted((a, b, k) for k, (_, ranges) in enumerate(SCRIPTS) for a, b in ranges)
_FIRST, _LAST = (np.array([r[k] for r in _RANGES], np.uint32) for k in (0, 1))
_BIT = np.array([1 << r[2] for r in _RANGES], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[BLANKS] = 32


def scripts_of(data: np.ndarray) -> np.ndarray:
    """For each byte the bit of the script of the character that begins there; 0 within characters and for those
    without a script."""
    low = np.arange(256, dtype=np.uint8)
    ascii_letter = ((low >= 0x41) & (low <= 0x5A)) | ((low >= 0x61) & (low <= 0x7A))
    out = ascii_letter.astype(np.uint64)[data]  # latin is the first script
    at = np.flatnonzero(data >= 0xC2)
    if len(at):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        lead = data[at].astype(np.uint32)
        one, two, three = (padded[at + k].astype(np.uint32) & np.uint32(0x3F) for k in (1, 2, 3))
        point = np.where(lead < 0xE0, (lead & 0x1F) << 6 | one, np.where(lead < 0xF0, (lead & 0x0F) << 12 | one << 6 | two, (lead & 0x07) << 18 | one << 12 | two << 6 | three))
        k = np.maximum(np.searchsorted(_FIRST, point, side="right") - 1, 0)
        out[at] = np.where((point >= _FIRST[k]) & (point <= _LAST[k]), _BIT[k], 0)
    return out


def _cells(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the cell of the trigram that ends there, within its word; blanks are -1."""
    low = _LOWER[data]
    x0 = low.astype(np.uint32)
    x1 = np.empty_like(x0)
    x1[:1], x1[1:] = 32, x0[:-1]
    x1[offsets[:-1][offsets[:-1] < len(x1)]] = 32
    x2 = np.empty_like(x0)
    x2[:1], x2[1:] = 32, x1[:-1]
    x2[x1 == 32] = 32
    h = ((x2 << np.uint32(16)) | (x1 << np.uint32(8)) | x0) * np.uint32(2654435761)
    return np.where(low == 32, -1, (h >> np.uint32(32 - CELL_BITS)).astype(np.int32))


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # language x cell
    scripts: np.ndarray  # language: bits

    @property
    def cut(self) -> int:
        """Bits that hashes are cut by."""
        return CELL_BITS - (self.logs.shape[1].bit_length() - 1) if len(self.languages) else 0

    @property
    def slice(self) -> int:
        """Bytes of text to look at together: a score for each word and language is held."""
        return max(1 << 14, SLICE * 16 // max(16, len(self.languages)))


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all ``rows``; those whose text or language is null teach nothing."""
    spark = rows.sparkSession
    ship(spark)
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    n_scripts = len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for k, v in sums.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["lang", "cell", "n"])
            sums.clear()

        for batch in pieces(batches, "text", SLICE // 2):
            langs = batch.column("lang").to_pylist()
            data, offsets = flat(batch.column("text"))
            cells, script = _cells(data, offsets), scripts_of(data)
            rows_of: dict[str, list[int]] = {}
            for i, k in enumerate(langs):
                rows_of.setdefault(k, []).append(i)
            for k, mine in rows_of.items():
                if k not in sums and len(sums) >= HELD:
                    yield from flush()
                own = sums.setdefault(k, np.zeros(CELLS + n_scripts, np.int64))
                if len(rows_of) == 1:
                    c, bits = cells, script
                else:
                    c, bits = (np.concatenate([x[offsets[i] : offsets[i + 1]] for i in mine]) for x in (cells, script))
                own[:CELLS] += np.bincount(c[c >= 0], minlength=CELLS)
                values, times = np.unique(bits[bits > 0], return_counts=True)
                for value, n in zip(values.tolist(), times.tolist()):
                    own[CELLS + value.bit_length() - 1] += n
        yield from flush()

    counts = cut(rows.mapInArrow(lean(count), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "counts")
    names = counts.select("lang").distinct().limit((MODEL_CELLS >> LEAST_BITS) + 1).collect()
    languages = sorted(r["lang"] for r in names)
    if len(languages) > MODEL_CELLS >> LEAST_BITS:
        raise ValueError("more languages than a model can hold")
    bits = max(LEAST_BITS, min(CELL_BITS, (MODEL_CELLS // max(len(languages), 1)).bit_length() - 1))
    small = F.when(F.col("cell") < CELLS, F.shiftright("cell", CELL_BITS - bits)).otherwise(F.col("cell") - CELLS + (1 << bits))
    got = counts.groupBy("lang", small.alias("cell")).agg(F.sum("n").alias("n")).toArrow()
    discard(counts)
    table = np.zeros((len(languages), (1 << bits) + n_scripts), np.float32)
    at = pc.index_in(got["lang"], pa.array(languages, pa.string())).to_numpy()
    table[at, got["cell"].to_numpy()] = got["n"].to_numpy()
    grams, marks = table[:, : 1 << bits], table[:, 1 << bits :]
    share = marks / np.maximum(marks.sum(1, keepdims=True), 1)
    scripts = ((share >= SCRIPT_SHARE) * (np.uint64(1) << np.arange(n_scripts, dtype=np.uint64))).sum(1).astype(np.uint64)
    grams = grams + np.float32(0.5)
    return Model(languages, np.log(grams / grams.sum(1, keepdims=True, dtype=np.float64)).astype(np.float32), scripts)


def word_scores(model: Model, data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Word x language: log likelihood, less the cost of a script that the language doesn't have."""
    cells = _cells(data, offsets)
    blank = cells < 0
    cells[blank] = 0
    cells >>= model.cut
    script = np.bitwise_or.reduceat(scripts_of(data), words.start) if len(words.start) else np.zeros(0, np.uint64)
    # reduceat runs up to the next word's start: blanks in between carry no script and count 0
    fits = (script[:, None] & model.scripts[None, :]) != 0
    lost = ~fits & fits.any(1)[:, None]
    out = np.empty((len(words.start), len(model.languages)), np.float32)
    for k in range(len(model.languages)):
        values = model.logs[k][cells]
        values[blank] = 0
        out[:, k] = np.add.reduceat(values, words.start) if len(words.start) else 0
    out -= OUTSIDE * lost
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language of each word of each row, all rows abreast: step t takes the t-th word of every row
    that has one."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    base, length = first[:-1][order], length[order]
    out = np.zeros(len(scores), np.int16)
    steps = int(length[0]) if len(length) else 0
    if not steps:
        return out
    alive = np.searchsorted(-length, -np.arange(steps), side="left")  # rows with more than t words
    kept, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    v = scores[base[: alive[0]]].astype(np.float64)
    for t in range(1, steps):
        n = alive[t]
        at, v = base[:n] + t, v[:n]
        top = v.argmax(1)
        bar = v[np.arange(n), top][:, None] - penalty
        stay = v >= bar
        kept[at], best[at] = stay, top
        v = np.where(stay, v, bar) + scores[at]
        if t + 1 == steps or alive[t + 1] < n:  # rows that end here
            m = alive[t + 1] if t + 1 < steps else 0
            out[at[m:]] = v[m:].argmax(1)
    m = alive[1] if steps > 1 else 0
    out[base[m : alive[0]]] = scores[base[m : alive[0]]].argmax(1)
    for t in range(steps - 1, 0, -1):
        at = base[: alive[t]] + t
        here = out[at]
        out[at - 1] = np.where(kept[at, here], here, best[at])
    return out


LABELLED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
])


def label(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", penalty: float = SWITCH) -> DataFrame:
    """Per row: ``spans`` of words by language, ``lang_pred`` (the language of most bytes in words) and its
    share of them as ``score``."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # at most MODEL_CELLS float32
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(has_letter(F.col(text)), F.lit(False)).alias("letters"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.languages, object)
        for batch in pieces(batches, "text", m.slice):
            data, offsets = flat(batch.column("text"))
            words = Words(data, offsets, BLANKS, lanes=0)
            n, k = batch.num_rows, len(m.languages)
            pred, score = np.full(n, "und", object), np.zeros(n)
            first, last, lang, ends = [], [], [], np.zeros(n + 1, np.int64)
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            if k and len(words.start):
                path = viterbi(word_scores(m, data, offsets, words), words.first, penalty)
                size = (words.end - words.start).astype(float)
                share = np.bincount(words.doc * k + path, weights=size, minlength=n * k).reshape(n, k)
                top, total = share.argmax(1), share.sum(1)
                letters &= total > 0
                pred[letters] = names[top[letters]]
                score[letters] = share[np.arange(n), top][letters] / total[letters]
                new = np.ones(len(path), bool)
                new[1:] = (path[1:] != path[:-1]) | (words.doc[1:] != words.doc[:-1])
                at = np.flatnonzero(new & letters[words.doc])
                to = np.append(np.flatnonzero(new)[1:], len(path))[np.searchsorted(np.flatnonzero(new), at)] - 1
                first, last, lang = at - words.first[words.doc[at]], to - words.first[words.doc[at]], names[path[at]]
                ends = np.searchsorted(words.doc[at], np.arange(n + 1))
            spans = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["lang", "first", "last"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=LABELLED.names
            )

    return rows.mapInArrow(lean(mark), LABELLED)


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def fold(key: str, parts: int) -> Column:
    """CRC32 of the key as text, modulo ``parts``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts
