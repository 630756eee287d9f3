import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from framesift.llm import phrase_dedup as pd
from framesift.llm.queries import OP4_SQL, op4_phrases


def brute(rows, width=13):
    """Kept words and number of words by row."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < i:
                    gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def got(df, **options):
    return [(x.doc_id, x.n_words, x.n_removed, x.kept) for x in pd.remove_repeats(df, **options).collect()]


def key(x):
    return (x[0] is None, x[0] or 0, *x[1:])


def test_random_texts_in_small_shards(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "漢字", " x", "\x85"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(11, 40))) for _ in range(12)]
    rows = [(i, " \n".join(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 20))) for _ in range(rng.randint(0, 6)))) for i in rng.sample(range(-500, 500), 150)]
    rows += [(rows[0][0], rows[1][1]), rows[2], (None, rows[3][1]), (None, None), (1000, None), (1001, ""), (1002, " ".join(passages) + " a" * 300), (1003, "a " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("shard", F.lit("x"))
    want = sorted(brute(rows), key=key)
    assert sum(x[2] for x in want) > 1000
    assert sorted(got(df, shard_bytes=1500, bucket_bytes=4000), key=key) == want
    assert sorted(got(df), key=key) == want
    assert pd.remove_repeats(df.limit(0)).count() == 0


def test_the_rest_keeps_its_line_breaks(spark):
    passage = "\n".join(f"p{k}" for k in range(13))
    rows = [(1, passage), (2, f" a\n\nb\t{passage}\nc é\n"), (3, f"x\n{passage}"), (4, None), (None, passage), (5, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rest", F.lit("clash"))
    got = {x.doc_id: x.rest for x in pd.remove_repeats(df, rest=True).collect()}
    assert got == {1: passage, 2: " a\n\nb\tc é\n", 3: "x\n", 4: "", None: passage, 5: ""}


def test_removed_stretches(spark):
    text = " ".join(f"p{k}" for k in range(13))
    df = spark.createDataFrame([(1, text), (2, f"a {text} b"), (3, text)], "doc_id long, text string")
    rows = {x.doc_id: x for x in pd.remove_repeats(df).collect()}
    assert (rows[2].kept, [tuple(x) for x in rows[2].removed]) == ("a b", [(1, 13)])
    assert rows[3].kept == "" and rows[1].removed == []


def test_words_that_fool_polynomial_hashes(spark):
    """The Thue-Morse word and its complement agree under any polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"h{k}" for k in range(12))
    rows = [(1, f"{head} {word}"), (2, f"{head} {other}"), (3, f"{head} {word}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(got(df), key=key) == sorted(brute(rows), key=key)


def test_one_key_with_a_third_of_all_rows(spark):
    rng = random.Random(3)
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else k, " ".join(rng.choices("abc", k=rng.randint(0, 40)))) for k in range(300)]
    rows += [(7, " ".join("abcabcabcabcabc"))] * 20
    assert sorted(got(spark.createDataFrame(rows, "doc_id long, text string"), shard_bytes=800, bucket_bytes=2000), key=key) == sorted(brute(rows), key=key)


def test_query_equals_brute_force_and_sql(spark, sf):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(rows))
    assert sorted(map(tuple, op4_phrases(spark, sf).collect())) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(con.sql(OP4_SQL).fetchall()) == want
