import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from framesift.llm import runtime
from framesift.llm.wordbytes import BLANKS, Words


def fake(master):
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(getConf=lambda: {}, master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)), setCheckpointDir=lambda path: None)
    return SimpleNamespace(sparkContext=context)


def test_a_folder_of_our_own_only_in_one_process():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            runtime.shared_dir(fake(master))
    for master in ("local", "local[*]", "local[4]"):
        assert os.path.isdir(runtime.shared_dir(fake(master)))


def test_sweep_deletes_what_was_written_since(spark):
    old = runtime.cut(spark.range(3))
    since = runtime.mark()
    a, b, c = (runtime.cut(spark.range(k)) for k in (4, 5, 6))
    runtime.discard(a)
    runtime.sweep(spark, since, c)
    assert old.count() == 3 and c.count() == 6
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE"):
        spark.read.parquet(b.inputFiles()[0]).count()


def test_lean_steps_keep_their_arguments():
    one, two = pa.table({"x": [1]}), pa.table({"x": [2, 3]})
    assert runtime.lean(lambda data: data)(one) is one
    assert runtime.lean(lambda left, right: right)(one, two) is two
    assert list(runtime.lean(lambda batches: (b for b in batches))(iter(one.to_batches()))) == one.to_batches()


def test_words_of_any_length_have_hashes_of_their_own():
    rng = np.random.default_rng(0)
    words = sorted({rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in [*range(1, 200)] * 20} | {b"a" * n for n in range(1, 300)})
    text = b" ".join(words)
    got = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), BLANKS, lanes=2)
    assert [text[a:b] for a, b in zip(got.start, got.end)] == words
    assert len(np.unique(got.hash)) == len(np.unique(got.more)) == len(words) and not np.isin(got.hash, got.more).any()
    again = Words(np.frombuffer(b"\n".join(words[::-1]), np.uint8), np.array([0, len(text)]), BLANKS)
    assert (again.hash[::-1] == got.hash).all()


@pytest.mark.parametrize("words", [runtime.SIEVE, 1])
def test_sieve_loses_no_row(spark, monkeypatch, words):
    monkeypatch.setattr(runtime, "SIEVE", words)
    among = spark.range(0, 4000, 4).selectExpr("id", "id * 7 AS h").unionByName(spark.createDataFrame([(-5, 3), (-5, 3), (None, 3)], "id long, h long"))
    df = spark.range(4000).selectExpr("id", "id * 7 AS h", "'t' AS text").unionByName(spark.createDataFrame([(-5, 3, "a"), (-5, 3, "b"), (-5, 4, "c")], "id long, h long, text string"))
    got = [tuple(x) for x in runtime.sieve(df, ["id", "h"], among).collect()]
    assert set(got) >= {(k, 7 * k, "t") for k in range(0, 4000, 4)} | {(-5, 3, "a"), (-5, 3, "b")} and len(got) == len(set(got))
    assert len(got) < 1050 or words == 1
    assert runtime.sieve(df, ["id", "h"], among.limit(0)).count() == 0
