import math
import re

from framesift.llm import licenses
from framesift.llm.queries import op7_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(text):
    words = WORD.findall(lower(text or ""))
    at = {k: [i for i in range(len(words)) if words[i : i + len(p)] == p] for k, p in BASE.items()}
    places = sorted(x for v in at.values() for x in v)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(k for k, v in at.items() if v))


def check(rows, texts):
    for x in rows:
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute(texts[x.doc_id])
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))
        assert 0 <= x.score <= 1 and (x.score > 0) == bool(x.labels)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = op7_licenses(spark, sf).collect()
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    check(rows, texts)
    assert any(x.n_base for x in rows)


def test_edges(spark):
    texts = {
        1: None, 2: "", 3: "CC-BY cc by\ncc", 4: "by cc", 5: "all rights", 6: "reserved All Rights RESERVED. all rights reserved",
        7: "GENERAL PUBLIC LICENSE" * 3, 8: "general public license " * 500, 9: "Áll rights reserved cc by",
        10: "Licensed under the Apache License, Version 2.0.", 11: "under the Apache License", 12: "Released under the MIT License.",
        13: "This work is licensed under the GNU General Public License, version 3.",
    }
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()] + [(3, texts[3], "x")], "doc_id long, text string, n_words string")
    rows = licenses.scan(df).collect()
    assert len(rows) == 14
    check(rows, texts)
    labels = {x.doc_id: x.labels for x in rows}
    assert labels[10] == "apache,apache-2.0" and labels[12] == "mit" and labels[13] == "gpl,gpl-3.0"
    span = next(x for x in rows if x.doc_id == 12).spans[0]
    assert (span.label, span.first, span.last) == ("mit", 0, 4)
    assert licenses.scan(df.limit(0)).count() == 0


def test_partial_template_has_partial_score(spark):
    whole = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    df = spark.createDataFrame([(1, whole), (2, whole.replace("conditions", "terms")), (3, whole.replace("binary", "object"))], "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(df).collect()}
    assert got[1].score == 1 and 0.6 <= got[2].score < 1 and got[3].labels == ""


def test_scan_equals_a_plain_search(spark):
    """Labels, spans and scores of all documents: every template tried at every word."""
    sf = "/root/testdata/sf0.001"
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    mit = next(t.words for t in licenses.TEMPLATES if t.label == "mit" and len(t.words) > 200)
    texts |= {90001: mit, 90002: mit[:-60], 90003: "x " + mit.replace("sublicense", "lend") + " all rights reserved", 90004: None, 90005: "cc by sa cc by"}
    split = {i: WORD.findall(lower(t or "")) for i, t in texts.items()}
    index = {w for t in licenses.TEMPLATES for w in t.words.split()}
    idf = {w: math.log((len(texts) + 1) / (sum(w in set(x) for x in split.values()) + 1)) + 1 for w in index}
    want = {}
    for i, words in split.items():
        want[i] = []
        for t in licenses.TEMPLATES:
            own, key = t.words.split(), t.key.split()
            k = next(k for k in range(len(own)) if own[k : k + len(key)] == key)
            every = sum(idf[w] for w in own)
            for at in range(len(words) - len(key) + 1):
                if words[at : at + len(key)] == key:
                    s = at - k
                    cover = sum(idf[w] for j, w in enumerate(own) if 0 <= s + j < len(words) and words[s + j] == w) / every
                    if cover >= 0.6 - 1e-12:
                        want[i].append((t.label, max(s, 0), min(s + len(own), len(words)) - 1, round(min(1, cover), 9)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for x in licenses.scan(df).collect():
        assert sorted((s.label, s.first, s["last"], round(s.coverage, 9)) for s in x.spans) == sorted(want[x.doc_id])
        assert x.labels == ",".join(sorted({w[0] for w in want[x.doc_id]})) and round(x.score, 9) == max((w[3] for w in want[x.doc_id]), default=0)
    assert {"mit", "reserved"} <= {w[0] for w in want[90003]} and want[90002] and want[90005]
