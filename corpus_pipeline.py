"""From documents to token ids: toxicity, near copies, repeated passages, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` applies them in order, each over what the one before wrote to the shared folder.

Nulls, empty texts, repeated rows and empty tables are treated as the operators in framesift.llm define;
a null text counts as a text without words: the first three stages keep it, mixing may sample it as
any other text that is unlikely to be good."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import bpe, dart_minhash, mixing, phrase_dedup, toxicity
from framesift.llm.queries import QUALITY
from framesift.llm.runtime import cut, mark, sweep, table

#: Shares of tokens wanted after mixing. Documents likely to be good all stay, others are sampled to these shares; where
#: poor tokens are fewer than that from the start, all documents stay.
TARGETS = {"good": 0.95, "poor": 0.05}
REJECT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose score for toxicity is at least ``REJECT``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_with(docs, model, evidence=0).where(F.col("score") < REJECT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each class of near copies (rows of one doc_id are told apart by
    their texts)."""
    gone = dart_minhash.near_duplicates(docs).where("NOT kept").select("doc_id", "text_hash").distinct()
    return docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"]), "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove phrases that an earlier document has too; what stays keeps its line breaks and blanks. Texts without such
    phrases stay as they are."""
    out = phrase_dedup.remove_repeats(docs, rest=True)
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("rest")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents of domains that the targets want less of; none is repeated."""
    out = mixing.mix_to_targets(docs, table(spark, sf_dir, "labels"), QUALITY, TARGETS, whole="good")
    return out.where("copies >= 1").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    op = bpe.Bpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = op.decode(op.encode(docs.select("doc_id", "source", "lang", "text")))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix),
    ("bpe", encode),
]

#: Nearest neighbours, signatures and a fitted mixture are not for SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; of the tables written on the way only the last stage's input stays."""
    docs, before = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        sweep(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
