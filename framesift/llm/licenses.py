"""Licence scans by a positional index of rare words.

Each template is a run of words, some of which form its mandatory key phrase. The index has postings: for each licence
word its places (template, position). Its lead postings are those of a word that is the rarest of the template's key
phrase. A file is looked up by its own licence words, the highest IDF first: each place of a word meets that word's lead
postings, which say where templates would start; the postings of the other key words are intersected by their place
relative to it, rarest first, until the key phrase is known to stand there whole; and the IDF share of the template's words
found at their places (``coverage``) must reach ``least``. A key phrase can't occur without its rarest word, so every place
is found. What a file costs follows its licence words and their lead postings, not the number of templates.

IDF comes from document frequencies over all files; only the counts of the templates' own words (a number that the
templates fix) are gathered.

Words are [0-9a-z and every character from U+0080 on], after A-Z become lower case. Defined cases: null
text counts as empty (no words, no labels, score 0); repeated rows each get their row; an empty table
gives none; other columns are not returned."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.llm.runtime import flat, lean, pieces, ship
from framesift.llm.wordbytes import Words, separators

BLANK = separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str  # a run of the words that must stand whole
    base: bool = False


#: The base phrases, and public licences by their notices, grants and conditions.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("agpl", "you should have received a copy of the gnu affero general public license along with this program", "affero general public license"),
    Template("apache", "licensed under the apache license", "apache license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "distributed on an as is basis without warranties or conditions of any kind"),
    Template("artistic-2.0", "the artistic license 2 0", "artistic license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    Template("bsl-1.0", "boost software license version 1 0", "boost software license"),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    Template("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "it under the terms of the gnu general public license"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-2.0", "either version 2 of the license or at your option any later version", "either version 2 of the license"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-3.0", "either version 3 of the license or at your option any later version", "either version 3 of the license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software for any purpose"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mit", "released under the mit license", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions of the software"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("ofl-1.1", "licensed under the sil open font license version 1 1", "sil open font license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "is provided as is without warranty of any kind"),
    Template("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "provided as is without any express or implied warranty in no event will the authors be held liable"),
)


def _hash(word: str) -> int:
    return int(Words(*flat(pa.array([word])), BLANK).hash[0])


class Index:
    """Positional index of templates; words are numbered by their sorted hashes."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        hashes = {w: _hash(w) for t in templates for w in t.words.split()}
        self.names = sorted(hashes, key=hashes.get)
        self.hashes = np.array([hashes[w] for w in self.names], np.uint64)
        number = {w: k for k, w in enumerate(self.names)}
        self.words = [np.array([number[w] for w in t.words.split()]) for t in templates]
        self.key_at = []
        for t in templates:
            words, key = t.words.split(), t.key.split()
            self.key_at.append(next(k for k in range(len(words)) if words[k : k + len(key)] == key))

    def number(self, words: Words) -> np.ndarray:
        """For each word its number in the index, or -1."""
        at = np.searchsorted(self.hashes, words.hash)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == words.hash, at, -1)

    def weigh(self, idf: np.ndarray) -> "Postings":
        return Postings(self, idf)


class Postings:
    """What a scan looks up: for each word its lead postings, and for each template its words in the order in which they
    are checked."""

    def __init__(self, index: Index, idf: np.ndarray):
        n = len(index.templates)
        self.length = np.array([len(w) for w in index.words])
        self.words = np.full((n, int(self.length.max(initial=0))), -1, np.int64)  # template x position
        self.weight = np.zeros(self.words.shape)
        checks, leads = [], []
        for t, (words, k, template) in enumerate(zip(index.words, index.key_at, index.templates)):
            self.words[t, : len(words)], self.weight[t, : len(words)] = words, idf[words] / idf[words].sum()
            key = np.arange(k, k + len(template.key.split()))
            checks.append(key[np.lexsort((key, -idf[words[key]]))])  # the key phrase, rarest word first
            leads.append((int(words[checks[-1][0]]), t, int(checks[-1][0])))
        self.key_length = np.array([len(x) for x in checks])
        self.checks = np.zeros((n, int(self.key_length.max(initial=0))), np.int64)
        for t, x in enumerate(checks):
            self.checks[t, : len(x)] = x
        leads.sort()
        self.lead_template, self.lead_place = (np.array([x[k] for x in leads], np.int64) for k in (1, 2))
        self.lead_at = np.searchsorted([x[0] for x in leads], np.arange(len(idf) + 1))  # by word
        self.idf = idf

    def candidates(self, ids: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Template and first word of every lead posting that a word meets, file by file, the highest IDF first. ``ids``:
        the licence words' numbers, ``place``: where they stand."""
        n = self.lead_at[ids + 1] - self.lead_at[ids]
        has = np.flatnonzero(n)
        has = has[np.lexsort((place[has], -self.idf[ids[has]], doc[has]))]
        n = n[has]
        posting = np.repeat(self.lead_at[ids[has]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.lead_template[posting], np.repeat(place[has], n) - self.lead_place[posting]


def _split(batch: pa.RecordBatch, text: str) -> Words:
    data, offsets = flat(batch.column(text))
    return Words(LOWER[data], offsets, BLANK)


def word_frequencies(df: DataFrame, index: Index, text: str = "text") -> tuple[np.ndarray, int]:
    """Over all files: how many have each of the index's words; how many there are."""
    ship(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(len(index.hashes) + 1, np.int64), 0
        for batch in pieces(batches, text):
            words = _split(batch, text)
            ids = index.number(words)
            rows += batch.num_rows
            has = ids >= 0
            pairs = np.unique(words.doc[has] * len(index.hashes) + ids[has])
            found[:-1] += np.bincount(pairs % len(index.hashes), minlength=len(index.hashes))
        found[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], names=["word", "n"])

    got = df.select(text).mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(index.hashes) + 1, np.int64)
    for row in got:
        out[row["word"]] = row["n"]
    return out[:-1], int(out[-1])


HITS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("coverage", T.DoubleType())]))),
])


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """Per file: counts, labels, the best coverage as ``score``, and ``spans`` (label, first and last word,
    coverage) for every place where a template stands."""
    spark = df.sparkSession
    ship(spark)
    index = Index(templates)
    found, files = word_frequencies(df, index, text)
    postings = index.weigh(np.array([math.log((files + 1) / (n + 1)) + 1 for n in found]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            words = _split(batch, text)
            ids = index.number(words)
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            known = np.flatnonzero(ids >= 0)
            template, start = postings.candidates(ids[known], words.doc[known], known)
            doc = np.zeros(len(start), np.int64)
            if len(start):
                doc = words.doc[start + postings.checks[template, 0]]  # where the lead word stands

            def stands(at: np.ndarray, word: np.ndarray) -> np.ndarray:
                """Which of the words lie at their places, in their own file."""
                inside = (at >= words.first[doc]) & (at < words.first[doc + 1])
                return inside & (ids[np.where(inside, at, 0)] == word)

            for k in range(postings.checks.shape[1]):  # intersect the key words' places, rarest first
                if not len(start):
                    break
                place = postings.checks[template, k]
                ok = (k >= postings.key_length[template]) | stands(start + place, postings.words[template, place])
                template, start, doc = template[ok], start[ok], doc[ok]
            cover = np.zeros(len(start))
            for k in range(int(postings.length[template].max(initial=0))):
                cover += postings.weight[template, k] * stands(start + k, postings.words[template, k])
            for t, s, d, c in zip(template.tolist(), start.tolist(), doc.tolist(), cover.tolist()):
                if c >= least - 1e-12:
                    base, last = int(words.first[d]), int(words.first[d + 1])
                    rows[d].append((templates[t].label, max(s - base, 0), min(s + len(index.words[t]), last) - base - 1, min(1.0, c), templates[t].base, s - base))
            out: dict[str, list] = {f.name: [] for f in HITS.fields}
            for d, spans in enumerate(rows):
                base = [s[5] for s in spans if s[4]]
                out["n_base"].append(len(base))
                out["first_word"].append(min(base, default=None))
                out["last_word"].append(max(base, default=None))
                out["base_labels"].append(",".join(sorted({s[0] for s in spans if s[4]})))
                out["labels"].append(",".join(sorted({s[0] for s in spans})))
                out["score"].append(max((s[3] for s in spans), default=0.0))
                out["spans"].append([dict(zip(("label", "first", "last", "coverage"), s[:4])) for s in sorted(spans)])
            out["doc_id"] = batch.column(doc_id).to_pylist()
            out["n_words"] = np.diff(words.first).tolist()
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], k) for f, k in zip(HITS.fields, kinds)], names=HITS.names)

    return df.select(doc_id, text).mapInArrow(lean(look), HITS)
