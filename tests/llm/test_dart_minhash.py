import random

import numpy as np
from pyspark.sql import functions as F

from framesift.llm import dart_minhash as dm
from framesift.llm.queries import op3_near_duplicates


def sets(text, width=5):
    w = (text or "").encode().split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def brute(rows, least=0.8):
    s = [sets(t) for _, t in rows]
    label = [i for i, _ in rows]
    links = [(x, y) for x in range(len(rows)) for y in range(x) if s[x] and s[y] and len(s[x] & s[y]) >= least * len(s[x] | s[y]) - 1e-12]
    changed = True
    while changed:
        changed = False
        for x, y in links:
            low = min(label[x], label[y])
            changed |= label[x] != label[y]
            label[x] = label[y] = low
    return {i: c for (i, _), c in zip(rows, label)}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
    return words


def corpus(seed=3):
    rng, out = random.Random(seed), []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 3, 25])):
            out.append(" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 45)))))
        chain = base
        for _ in range(6):  # a chain: neighbours are alike, ends are not
            chain = edited(rng, chain, max(1, len(base) // 60))
            out.append(" ".join(chain))
    out += ["a b", "a b", "a c", "", None, "x\ty\nz", "x y z"] + out[:9]
    rng.shuffle(out)
    return list(enumerate(out, 10))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(set(want.values())) < len(rows) * 0.6
    for settings in (dm.Settings(block=1024), dm.Settings(block=5), dm.Settings(block_bytes=20_000)):
        got = dm.near_duplicates(df, settings).collect()
        assert {x.doc_id: x.class_id for x in got} == want and len(got) == len(rows)
        assert all(x.kept == (x.class_id == x.doc_id) for x in got)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    b[:200] = a[:200]
    element = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    row = np.repeat([0, 1], 300)
    weight = np.concatenate([a, b]).astype(float)
    some = weight > 0
    s = dm.signatures(row[some], np.tile(element, 2)[some], weight[some], 3, 4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.03 and not s[2].any()
    assert (dm.signatures(np.zeros(1, int), element[:1], np.ones(1), 1, 64) != 0).all()


def test_weights_count_repeats(spark):
    texts = [(1, "a b c d e " * 20), (2, "a b c d e " * 3), (3, "a b c d e " * 20 + "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert [x.class_id for x in dm.near_duplicates(df, dm.Settings(weighted=True)).orderBy("doc_id").collect()] == [1, 2, 1]


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.class_id or 0, x.kept) for x in dm.near_duplicates(df).collect())
    assert got == [(0, 0, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert dm.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_doc_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{p}{k}" for k in range(60)) for p in "ab")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (1, "c d e f g h"), (4, "c d e f g i")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "h": F.lit(2), "class_id": F.lit(0), "node": F.lit(0)})
    got = sorted((x.doc_id, x.class_id, x.kept) for x in dm.near_duplicates(df).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True)]


def test_words_that_fool_polynomial_hashes(spark):
    """The Thue-Morse word and its complement agree under any polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word), (4, "long " * 300_000)], "doc_id long, text string")
    assert [x.class_id for x in dm.near_duplicates(df).orderBy("doc_id").collect()] == [1, 2, 1, 4]


def test_texts_without_near_copies_are_not_shuffled(spark):
    """Whether or not the table of groups is small enough to be sent to the texts."""
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(3000)) for _ in range(120)]
    rows = list(enumerate(texts)) + [(500, texts[3] + " more"), (500, texts[3] + " more"), (501, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id").cache()
    df.count()

    def shuffled():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before, small = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {x.doc_id: x.class_id for x in dm.near_duplicates(df).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
        df.unpersist()
    assert got == {k: k for k in range(120)} | {500: 3, 501: 4}
    assert 0 < shuffled() - before < sum(map(len, texts)) / 10


def test_query_equals_brute_force(spark, sf):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {x.doc_id: x.class_id for x in op3_near_duplicates(spark, sf).collect()} == brute(rows)
