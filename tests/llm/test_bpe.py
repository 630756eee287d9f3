import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from framesift.llm import bpe
from framesift.llm.queries import op1_bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TREE = bpe.TreeEncoder(RANKS, public_tokenizers.PATTERN, leaf=3)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab' \n\tzé漢1²'!.-_　\x85\x1cst"), max_size=80))
def test_tiny_leaves_equal_the_library(text):
    assert TREE.encode(text).tolist() == PLAIN.encode_ordinary(text)
    assert TREE.decode(TREE.encode(text), leaf=2) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert TREE.encode(text).tolist() == PLAIN.encode_ordinary(text)


def test_long_runs_join_token_by_token():
    for unit in ("abcab", "the", "漢字", "7", " ", "\n", "=-", "aaab", "intheand"):
        for n in (900, 3001):
            text = "x1 " + unit * n + " end"
            assert bpe.TreeEncoder(RANKS, public_tokenizers.PATTERN, leaf=64).encode(text).tolist() == PLAIN.encode_ordinary(text)


def test_very_long_blanks_do_not_overflow():
    ids = bpe.TreeEncoder(RANKS, public_tokenizers.PATTERN).encode("\n" * 300_000 + "a")
    assert TREE.decode(ids) == b"\n" * 300_000 + b"a"


def test_operator_nulls_empties_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "It's  here\n" * 900, "z"), (3, "It's  here\n" * 900, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    op = bpe.Bpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = op.decode(op.encode(df)).collect()
    assert [x.ids == PLAIN.encode_ordinary(t or "") for x, (_, t, _) in zip(out, rows)] == [True] * 4
    assert [bytes(x.decoded).decode() for x in out] == [t or "" for _, t, _ in rows]
    assert op.encode(df.limit(0)).count() == 0


def test_query_equals_the_library(spark, sf):
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for x in got:
        ids = PLAIN.encode_ordinary(texts[x.doc_id])
        assert x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()
