import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from framesift.llm import langid
from framesift.llm.queries import op10_langid


def brute_path(scores, penalty):
    v, back = scores[0].astype(float), []
    for s in scores[1:]:
        bar = v.max() - penalty
        back.append([k if v[k] >= bar else int(v.argmax()) for k in range(len(v))])
        v = np.maximum(v, bar) + s
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_viterbi_equals_the_plain_recursion():
    rng = np.random.default_rng(3)
    lengths = [0, 1, 7, 3, 0, 30, 1, 7]
    first = np.cumsum([0, *lengths])
    scores = rng.normal(size=(first[-1], 4)).astype(np.float32) * 3
    got = langid.viterbi(scores, first, 4.0)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert got[a:b].tolist() == brute_path(scores[a:b], 4.0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {x.doc_id: x for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_langid(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 for x in rows)
    held = [x for x in rows if x.held_out and any(map(str.isalpha, docs[x.doc_id].text or ""))]
    assert np.mean([x.lang_pred == docs[x.doc_id].lang for x in held]) > 0.95


def model(spark):
    rows = [("the house and the garden of the king " * 5, "en"), ("das haus und der garten des königs " * 5, "de"), ("дом и сад короля " * 5, "ru"), (None, "fr"), ("x", None)]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_mixed_text_is_labelled_by_spans(spark):
    m = model(spark)
    assert m.languages == ["de", "en", "ru"]
    rows = [(1, "the garden of the king and the house das haus und der garten des königs und der garten"), (2, None), (3, ""), (4, "12 -- 7"), (5, "сад дом"), (6, "the the"), (6, "the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit("xx"))
    got = [x for x in langid.label(df, m).collect()]
    assert len(got) == 7
    one = next(x for x in got if x.doc_id == 1)
    assert [(s.lang, s.first, s.last) for s in one.spans] == [("en", 0, 7), ("de", 8, 17)]
    assert one.lang_pred in ("de", "en") and 0 < one.score < 1
    assert [(x.lang_pred, x.score, x.spans) for x in got if x.doc_id in (2, 3, 4)] == [("und", 0.0, [])] * 3
    assert next(x for x in got if x.doc_id == 5).lang_pred == "ru"


def test_without_training_rows(spark):
    empty = langid.train(spark.createDataFrame([], "text string, lang string"))
    df = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert langid.label(df, empty).first()[:3] == (1, "und", 0.0)


def test_empty_table_and_very_long_text(spark):
    m = model(spark)
    df = spark.createDataFrame([(1, "the garden of the king " * 50_000), (None, "das haus " * 3)], "doc_id long, text string")
    got = {x.doc_id: (x.lang_pred, x.score, len(x.spans)) for x in langid.label(df, m).collect()}
    assert got == {1: ("en", 1.0, 1), None: ("de", 1.0, 1)}
    assert langid.label(df.limit(0), m).count() == 0


def test_scripts_by_code_point():
    for text, name in (("é", "latin"), ("Ế", "latin"), ("ἄ", "greek"), ("ж", "cyrillic"), ("ა", "georgian"), ("क", "devanagari"), ("ก", "thai"), ("あ", "kana"), ("漢", "han"), ("𠀀", "han"), ("한", "hangul"), ("ש", "hebrew"), ("ب", "arabic"), ("አ", "ethiopic")):
        data = np.frombuffer(f" {text}1".encode(), np.uint8)
        bits = langid.scripts_of(data)
        assert [x for x in bits.tolist() if x] == [1 << [n for n, _ in langid.SCRIPTS].index(name)], text
    assert not langid.scripts_of(np.frombuffer("1 – … 🙂 ÷×".encode(), np.uint8)).any()


def test_more_languages_than_cells_for_all(spark, monkeypatch):
    """All are learned; cells are shared where they get many."""
    monkeypatch.setattr(langid, "MODEL_CELLS", 1 << 19)
    monkeypatch.setattr(langid, "HELD", 7)
    rng = np.random.default_rng(4)
    syllables = [chr(97 + a) + chr(97 + b) + chr(97 + c) for a, b, c in rng.integers(0, 26, (2000, 3))]
    words = [["".join(rng.choice(syllables[k * 20 : k * 20 + 20], 2)) for _ in range(60)] for k in range(100)]
    rows = [(" ".join(rng.choice(words[k], 80)), f"l{k:03}") for k in range(100) for _ in range(3)]
    m = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert len(m.languages) == 100 and m.logs.shape[1] == 4096 and m.cut == 5
    df = spark.createDataFrame([(k, " ".join(rng.choice(words[k], 30))) for k in range(100)], "doc_id long, text string")
    assert np.mean([x.lang_pred == f"l{x.doc_id:03}" for x in langid.label(df, m).collect()]) > 0.95


def test_query_equals_a_plain_model(spark):
    """Counts, scores, paths and shares of all documents by loops over words and bytes."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()

    def split(text):
        return [w for w in re.split(rb"[ \t-\r]+", (text or "").encode()) if w]

    def cells(word):
        low = b"  " + bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in word)
        return [((low[k] << 16 | low[k + 1] << 8 | low[k + 2]) * 2654435761 % (1 << 32)) >> 15 for k in range(len(word))]

    def script(char):
        return next((k for k, (_, ranges) in enumerate(langid.SCRIPTS) if any(a <= ord(char) <= b for a, b in ranges)), None)

    grams, marks = {}, {}
    for x in docs:
        if x.lang is not None and x.text is not None and zlib.crc32(str(x.doc_id).encode()) % 3 != 1:
            g, s = grams.setdefault(x.lang, Counter()), marks.setdefault(x.lang, Counter())
            for w in split(x.text):
                g.update(cells(w))
                s.update(k for c in w.decode() if (k := script(c)) is not None)
    names = sorted(grams)
    total = {n: sum(grams[n].values()) + 0.5 * langid.CELLS for n in names}
    has = {n: {k for k, c in marks[n].items() if c >= 0.01 * sum(marks[n].values())} for n in names}
    for x in op10_langid(spark, sf).collect():
        words = split(next(d.text for d in docs if d.doc_id == x.doc_id))
        if not any(c.isalpha() for w in words for c in w.decode()):
            assert (x.lang_pred, x.score) == ("und", 0)
            continue
        scores = np.array([[sum(np.log((grams[n][c] + 0.5) / total[n]) for c in cells(w)) for n in names] for w in words])
        for i, w in enumerate(words):
            fits = [bool(has[n] & {script(c) for c in w.decode()}) for n in names]
            if any(fits):
                scores[i] -= [0 if f else langid.OUTSIDE for f in fits]
        share = Counter()
        for k, w in zip(brute_path(scores, langid.SWITCH), words):
            share[names[k]] += len(w)
        best = max(names, key=lambda n: share[n])
        assert x.lang_pred == best and abs(x.score - share[best] / sum(share.values())) < 1e-3
