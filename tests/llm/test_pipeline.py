import public_tokenizers
import tiktoken
from test_dart_minhash import brute as near_copies
from test_phrase_dedup import brute as passages

import corpus_pipeline as cp
from framesift.llm import bpe


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {x.doc_id: x for x in docs.collect()}
    labels = {x.doc_id: x for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "bpe"]

    def after(stage, docs):
        out = cp.cut(dict(cp.STAGES)[stage](spark, docs, sf))
        if stage != "bpe":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        return out, {x.doc_id: x for x in out.collect()}

    clean, kept = after("toxicity", docs)
    toxic, fine = ([i for i, x in labels.items() if x.toxic == v] for v in (1, 0))
    assert sum(i not in kept for i in toxic) > 0.6 * len(toxic)
    assert sum(i not in kept for i in fine) < 0.05 * len(fine)
    assert all(kept[i] == before[i] for i in kept)

    single, left = after("near_dedup", clean)
    classes = near_copies([(i, x.text) for i, x in sorted(kept.items())])
    assert set(left) == {i for i, c in classes.items() if i == c}

    short, cutout = after("substring_dedup", single)
    want = {i: (m, k) for i, _, m, k in passages([(i, x.text) for i, x in left.items()])}
    assert set(cutout) == set(want) and all(x.n_chars == len(x.text) for x in cutout.values())
    assert all(b" ".join(x.text.encode().split()).decode() == want[i][1] if want[i][0] else x.text == left[i].text for i, x in cutout.items())
    # line breaks stand where they stood: what stays between two removed stretches is a stretch of the text
    assert any("\n" in x.text for i, x in cutout.items() if want[i][0])
    for i, x in cutout.items():
        at = 0
        for line in x.text.split("\n") if want[i][0] else []:
            for part in line.split():
                at = left[i].text.index(part, at) + len(part)

    mixed, chosen = after("mixing", short)
    assert all(chosen[i] == cutout[i] for i in chosen)
    good, poor = ([i for i in cutout if i in labels and labels[i].quality == v] for v in (1, 0))
    assert sum(i in chosen for i in good) > 0.97 * len(good)
    assert sum(i in chosen for i in poor) < 0.95 * len(poor)

    _, ids = after("bpe", mixed)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert set(ids) == set(chosen)
    assert all(x.round_trip and x.ids == plain.encode_ordinary(chosen[i].text or "") and x.n_tokens == len(x.ids) for i, x in ids.items())


def test_nulls_and_repeats_pass_through(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(90001, None, None, None, None), (90002, "", "en", "s", 0), (None, "a text", "en", "s", 6), *[(90003, "twice the same", "en", "s", 14)] * 2, (90004, "a very long text " * 60_000, "en", "s", 1_020_000)]
    odd = spark.createDataFrame(odd, docs.schema)
    for name, stage in cp.STAGES:
        odd_out = stage(spark, docs.unionByName(odd), sf)
        assert odd_out.where("doc_id > 90000").count() == 5 or name == "mixing", name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
