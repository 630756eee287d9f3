"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents."""
    import public_tokenizers

    from framesift.llm import bpe

    op = bpe.Bpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return op.both(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.digests, bpe.DIGESTS)


#: Domains by the labels table, and the shares of tokens wanted of each.
QUALITY = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END"
TARGETS = {"good": 0.8, "poor": 0.15, "toxic": 0.05}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of all documents for target shares of three domains."""
    from framesift.llm import mixing

    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    return mixing.mix_to_targets(docs.select("doc_id", "text"), labels, QUALITY, TARGETS, with_text=False)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document: five-word runs, similarity 0.8. The similarity asked for is that of sets
    of runs, so all weights are 1 here; ``Settings(weighted=True)`` counts repeats."""
    from framesift.llm import dart_minhash

    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


#: Sets of five-word runs, pairs by shared runs, and what hangs together. For small tables.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS h FROM g
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)
), r(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
)
SELECT x AS doc_id, min(y) AS class_id, min(y) = x AS kept FROM r GROUP BY x
"""


def op4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove words of 13-word phrases that start in an earlier document too."""
    from framesift.llm import phrase_dedup

    out = phrase_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS s, w FROM d WHERE len(w) >= 13
), p AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 12], ' ')) AS h FROM g
), f AS (
  SELECT h, min(doc_id) AS first_doc FROM p GROUP BY h
), c AS (
  SELECT DISTINCT p.doc_id, unnest(range(p.s, p.s + 13)) AS i FROM p JOIN f USING (h) WHERE f.first_doc < p.doc_id
), r AS (
  SELECT doc_id, count(*) AS n, list(i) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN r.n IS NULL THEN d.w ELSE
         list_transform(list_filter(list_zip(d.w, range(1, len(d.w) + 1)), lambda x: NOT list_contains(r.gone, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffle all documents into 40 shards; the digest is taken from the shuffled records."""
    from framesift.llm import shards

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shards.shuffle_into_shards(docs, 40, ["doc_id", "text"])
    return out.select(
        "doc_id", shards.record_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5_shards' law says of each shard: rows, the last slot, and the bytes of all of them."""
    rows = op5_shards(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("n_slots"))
    return rows.select(F.col("shard").cast("long").alias("shard"), "n_rows", "first_slot", "last_slot", "n_slots")


SHARD_COUNTS_SQL = """
WITH t AS (SELECT count(*) AS n FROM documents), s AS (SELECT unnest(range(0, 40)) AS shard)
SELECT shard, n_rows, 0::BIGINT AS first_slot, n_rows - 1 AS last_slot, n_rows AS n_slots
FROM (SELECT shard, n // 40 + CASE WHEN shard < n % 40 THEN 1 ELSE 0 END AS n_rows FROM s, t) WHERE n_rows > 0
"""


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every record that op5_shards placed."""
    return op5_shards(spark, sf_dir).select("doc_id", "size", "law", "grown_shard")


SHARD_SIZES_SQL = "SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, 'rows' AS law, CAST(NULL AS INTEGER) AS grown_shard FROM documents"


def op6_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th vector with all others."""
    from framesift.llm import kdtree

    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS f FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.f, v.f) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.f) = len(q.f)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every document for licence phrases."""
    from framesift.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def licence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_licenses says of the base phrases."""
    return op7_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENCE_PLACES_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), e AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), h AS (
  SELECT doc_id, i - 1 AS place, CASE WHEN w[i : i + 1] = ['cc', 'by'] THEN 'cc-by' WHEN w[i : i + 2] = ['general', 'public', 'license'] THEN 'gpl'
    WHEN w[i : i + 2] = ['all', 'rights', 'reserved'] THEN 'reserved' END AS label FROM e
), f AS (
  SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM h WHERE label IS NOT NULL GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN f USING (doc_id)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; learn from labelled rows outside the held-out fifth."""
    from framesift.llm import toxicity
    from framesift.llm.langid import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    scored = toxicity.score(docs, model, evidence=0)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link all vectors with a cosine of 0.9 or more."""
    from framesift.llm import embedding_dedup

    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


#: All pairs; for small tables. The query finds a pair just at the threshold with a probability of 0.995 at least.
OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), n AS (
  SELECT x, count(*) AS n FROM l GROUP BY x
), r(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
)
SELECT r.x AS vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(y) AS component_id, min(y) = r.x AS kept FROM r LEFT JOIN n ON n.x = r.x GROUP BY r.x
"""


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language; learn from those outside the held-out third."""
    from framesift.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(langid.fold("doc_id", 3) != 1))
    return langid.label(docs, model).select("doc_id", (langid.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_phrases": op4_phrases,
    "op5_shards": op5_shards,
    "op6_kdtree": op6_kdtree,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_langid": op10_langid,
    "shard_counts": shard_counts,
    "shard_sizes": shard_sizes,
    "licence_places": licence_places,
}
ORACLE: dict[str, str] = {
    "op3_near_duplicates": OP3_SQL, "op4_phrases": OP4_SQL, "op6_kdtree": OP6_SQL, "op9_embedding_dedup": OP9_SQL,
    "shard_counts": SHARD_COUNTS_SQL, "shard_sizes": SHARD_SIZES_SQL, "licence_places": LICENCE_PLACES_SQL,
}
