"""Queries over the star-schema tables that exercise the engine's operators, and the same in SQL.

Fixtures: a document is a segment of a video (ten to a video) that lasts as many milliseconds as it has
characters; an embedding is a frame (two to a segment), and every 50th one is a task too. Scores of the second
stage are an exact integer hash, so that SQL can tell them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.functions import paths, sampling, text, vectors
from framesift.operators import manifest, merge, partition, progress, rerank, shots, topk, validate
from framesift.session import scratch, tune
from framesift.sources import corpus, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The search's queries: every row whose id is divisible by this, against all rows.
TASK_EVERY, DIMENSION = 50, 48
LIMIT, CENTERS, WINDOW_MS, FINE_FPS, MOST = 500, 30, 750, 8.0, 10


def query(sql: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(tune(spark), sf_dir)

        QUERIES[function.__name__] = run
        ORACLE[function.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- fixtures -----------------------------------------------------------------------------------------


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    video = sampling.div(F.col("doc_id"), 10)
    end = F.sum("n_chars").over(Window.partitionBy(video).orderBy("doc_id"))
    out = docs.select(F.concat(F.lit("v"), video).alias("video_id"), F.col("doc_id").alias("shot_id"), "n_chars", end.cast("long").alias("shot_end_ms"))
    return out.withColumn("shot_start_ms", F.col("shot_end_ms") - F.col("n_chars")).drop("n_chars")


SHOTS = """shots AS (
  SELECT 'v' || (doc_id // 10) AS video_id, doc_id AS shot_id, e AS shot_end_ms, e - n_chars AS shot_start_ms FROM (
    SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS BIGINT) AS e FROM documents))"""


def _samples_sql(source: str, fps: float) -> str:
    """SQL for ``source`` (with shot_start_ms and shot_end_ms) with its frames, as ``x``."""
    step = f"greatest(1, CAST(round_even(1000.0 / {fps}, 0) AS BIGINT))"
    return f"""SELECT *, unnest(CASE
      WHEN e - s <= 2000 THEN [{{'frame_ms': s + (e - s) // 2, 'sample': 'mid'}}]
      WHEN e - s <= 5000 THEN [{{'frame_ms': s + (e - s) // 3, 'sample': 'third_1'}}, {{'frame_ms': s + (2 * (e - s)) // 3, 'sample': 'third_2'}}]
      WHEN s + {step} // 2 < e THEN list_transform(range(s + {step} // 2, e, {step}), lambda v, i: {{'frame_ms': v, 'sample': 'long_' || printf('%04d', i - 1)}})
      ELSE [{{'frame_ms': s + (e - s) // 2, 'sample': 'long_0000'}}] END) AS x
    FROM (SELECT *, greatest(0, shot_start_ms) AS s, greatest(greatest(0, shot_start_ms) + 1, shot_end_ms) AS e FROM {source})"""


def _tasks(spark: SparkSession, sf_dir: str, dimension: int | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % TASK_EVERY == 0)
    vector = F.col("embedding") if dimension is None else vectors.prepare(F.col("embedding"), dimension)
    return rows.select(F.concat(F.lit("T"), "vec_id").alias("task_id"), vector.alias("query"))


def _frames(spark: SparkSession, sf_dir: str, dimension: int | None = None) -> DataFrame:
    shot = sampling.div(F.col("vec_id"), 2)
    video = F.concat(F.lit("v"), sampling.div(shot, 10))
    vector = F.col("embedding") if dimension is None else vectors.prepare(F.col("embedding"), dimension)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("source_index"), video.alias("video_id"), shot.alias("shot_id"), text.shot_uid(video, shot).alias("shot_uid"), vector.alias("embedding"))


def _retrieval_sql(k: int, dimension: int | None = None) -> str:
    v = "CAST(embedding AS DOUBLE[])" + (f"[1:{dimension}]" if dimension else "")
    unit = "list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))" if dimension else "v"
    return f"""vecs AS (SELECT vec_id, {unit} AS q FROM (SELECT vec_id, {v} AS v FROM embeddings)),
scored AS (
  SELECT 'T' || t.vec_id AS task_id, f.vec_id AS source_index, 'v' || (f.vec_id // 2 // 10) AS video_id, f.vec_id // 2 AS shot_id,
         'v' || (f.vec_id // 2 // 10) || ':' || (f.vec_id // 2) AS shot_uid, list_dot_product(f.q, t.q) AS score
  FROM vecs t JOIN vecs f ON t.vec_id % {TASK_EVERY} = 0),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY task_id, shot_uid ORDER BY score DESC, source_index) = 1),
cand AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, source_index) AS rank FROM best QUALIFY rank <= {k})"""


def _hash_score(frames: DataFrame) -> DataFrame:
    task = F.substring("task_id", 2, 9).cast("long")
    h = (task * 7919 + F.col("shot_id") * 104729 + F.col("frame_ms") * 31) % 10007
    return frames.withColumn("reranker_score", h / F.lit(10007.0))


_HASH = "((CAST(task_id[2:] AS BIGINT) * 7919 + shot_id * 104729 + frame_ms * 31) % 10007) / 10007.0::DOUBLE AS reranker_score"


def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = _shots(spark, sf_dir).select("video_id").distinct()
    return videos.where(F.substring("video_id", 2, 9).cast("long") % 7 != 3)


_kept: list[DataFrame] = []


def _rerank(spark: SparkSession, sf_dir: str, most: int = MOST) -> rerank.Rerank:
    """The second stage over the retrieval's candidates; every seventh video can't be read. What it keeps is given up by the
    next call: a result that is read later is computed again."""
    while _kept:
        _kept.pop().unpersist()
    found = topk.retrieve(_tasks(spark, sf_dir), _frames(spark, sf_dir), LIMIT)
    null = F.lit(None).cast("long")
    candidates = found.select("task_id", "video_id", "shot_id", "rank", "score", "embedding_score", null.alias("frame_ms"), null.alias("shot_start_ms"), null.alias("shot_end_ms"))
    known = _shots(spark, sf_dir).withColumnsRenamed({"shot_start_ms": "start_ms", "shot_end_ms": "end_ms"})
    return rerank.Rerank(candidates, known, _hash_score, _readable(spark, sf_dir), LIMIT, CENTERS, WINDOW_MS, FINE_FPS, 1.0, most, lambda df: _kept.append(df.persist()) or _kept[-1])


def _rerank_sql(last: str, most: int = MOST) -> str:
    ties = "reranker_score DESC, score DESC, video_id, shot_start_ms, shot_id, frame_ms"
    step = int(round(1000 / FINE_FPS))
    return f"""WITH {SHOTS}, {_retrieval_sql(LIMIT)},
bounds AS (SELECT c.task_id, c.video_id, c.shot_id, c.shot_uid, c.score, c.rank AS position, coalesce(s.shot_start_ms, 0) AS shot_start_ms, coalesce(s.shot_end_ms, 0) AS shot_end_ms
  FROM cand c LEFT JOIN shots s USING (video_id, shot_id)),
readable AS (SELECT * FROM bounds WHERE video_id IN (SELECT video_id FROM shots WHERE CAST(video_id[2:] AS BIGINT) % 7 <> 3)),
sampled AS ({_samples_sql('readable', 1.0)}),
coarse AS (SELECT *, {_HASH} FROM (SELECT task_id, video_id, shot_id, shot_uid, score, shot_start_ms, shot_end_ms, x.frame_ms AS frame_ms, x.sample AS sample FROM sampled)),
per_shot AS (SELECT * FROM coarse QUALIFY row_number() OVER (PARTITION BY task_id, shot_uid ORDER BY {ties}) = 1),
centers AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {ties}) AS center_rank FROM per_shot QUALIFY center_rank <= {CENTERS}),
grid AS (SELECT DISTINCT * FROM (SELECT task_id, video_id, shot_id, shot_uid, score, shot_start_ms, shot_end_ms, frame_ms AS center, unnest(list_transform(range(-{WINDOW_MS}, {WINDOW_MS} + 1, {step}), lambda o: frame_ms + o) || [frame_ms]) AS frame_ms FROM centers)
  WHERE frame_ms BETWEEN greatest(shot_start_ms, center - {WINDOW_MS}) AND least(shot_end_ms, center + {WINDOW_MS})),
fine AS (SELECT *, {_HASH} FROM grid g WHERE NOT EXISTS (SELECT 1 FROM coarse c WHERE c.task_id = g.task_id AND c.shot_uid = g.shot_uid AND c.frame_ms = g.frame_ms)),
every AS (SELECT task_id, video_id, shot_id, shot_uid, score, shot_start_ms, frame_ms, 0 AS isf, 0 AS center, reranker_score FROM coarse
  UNION ALL SELECT task_id, video_id, shot_id, shot_uid, score, shot_start_ms, frame_ms, 1, center, reranker_score FROM fine),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY reranker_score DESC, isf DESC, score DESC, video_id,
  CASE WHEN isf = 1 THEN center ELSE shot_start_ms END, CASE WHEN isf = 1 THEN 0 ELSE shot_id END, frame_ms, shot_uid) AS rank FROM every),
staged AS (SELECT task_id, video_id, frame_ms, 0 AS stage, rank AS pos FROM ranked UNION ALL SELECT task_id, video_id, 0, 1, position FROM bounds),
chosen AS (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY task_id, video_id ORDER BY stage, pos) = 1),
selected AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY stage, pos) AS rank, video_id, frame_ms, stage FROM chosen QUALIFY rank <= {most})
{last}"""


# -- sampling and shots -------------------------------------------------------------------------------

_FRAMES_OUT = "video_id, shot_id, x.frame_ms AS frame_ms, x.sample AS sample"


def _sampled(spark: SparkSession, sf_dir: str, fps: float) -> DataFrame:
    return manifest.sample_shots(_shots(spark, sf_dir), fps).select("video_id", "shot_id", "frame_ms", "sample")


@query(f"WITH {SHOTS} SELECT {_FRAMES_OUT} FROM ({_samples_sql('shots', 0.25)})")
def sample_frames_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir, 0.25)


@query(f"WITH {SHOTS} SELECT {_FRAMES_OUT} FROM ({_samples_sql('shots', 1.0)})")
def sample_frames_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir, 1.0)


@query(f"""WITH {SHOTS}, c AS (SELECT *, greatest(shot_start_ms, least(shot_end_ms, shot_start_ms + 700)) AS c FROM shots)
SELECT DISTINCT video_id, shot_id, t AS frame_ms FROM (SELECT *, unnest(list_transform(range(-750, 751, 125), lambda o: c + o) || [c]) AS t FROM c)
WHERE t BETWEEN greatest(shot_start_ms, c - 750) AND least(greatest(shot_start_ms, shot_end_ms), c + 750)""")
def fine_scan_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = sampling.fine_scan_times(F.col("shot_start_ms") + 700, "shot_start_ms", "shot_end_ms", WINDOW_MS, FINE_FPS)
    return _shots(spark, sf_dir).select("video_id", "shot_id", F.explode(times).alias("frame_ms"))


@query(f"""WITH {SHOTS}, f AS ({_samples_sql('shots', 0.25)})
SELECT CAST(row_number() OVER (ORDER BY video_id, shot_id, x.sample) - 1 AS BIGINT) AS source_index, video_id || ':' || shot_id AS shot_uid, {_FRAMES_OUT} FROM f""")
def frame_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shots(spark, sf_dir).withColumns({"file_order": F.col("video_id"), "shot_pos": F.col("shot_id"), "video_path": F.lit("")})
    return manifest.frame_manifest(rows, 0.25).select("source_index", "shot_uid", "video_id", "shot_id", "frame_ms", "sample")


@query(f"""WITH {SHOTS}, f AS ({_samples_sql('shots', 0.25)})
SELECT (SELECT count(DISTINCT video_id) FROM shots) AS video_count, (SELECT count(*) FROM shots) AS shot_count, (SELECT count(*) FROM f) AS frame_count,
       (SELECT count(DISTINCT video_id) FROM shots WHERE CAST(video_id[2:] AS BIGINT) % 7 = 3) AS missing_video_count""")
def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    shot = F.struct("shot_id", F.col("shot_start_ms").alias("start_ms"), F.col("shot_end_ms").alias("end_ms"))
    videos = _shots(spark, sf_dir).groupBy("video_id").agg(F.collect_list(shot).alias("shots"))
    return manifest.manifest_stats(videos.withColumn("exists", F.substring("video_id", 2, 9).cast("long") % 7 != 3), 0.25)


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video a lineitem order: frames from quantity and part, some reversed, some beyond the end."""
    rows = table(spark, sf_dir, "lineitem")
    pair = F.array(F.col("l_quantity") * 7.5, F.col("l_partkey") % 500 + 0.5)
    out = rows.select(F.col("l_orderkey").alias("video_id"), "l_linenumber", "l_partkey", pair.alias("range"))
    out = out.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "range"))).alias("r"))
    return out.select("video_id", F.transform("r", lambda x: x["range"]).alias("ranges"), (F.col("video_id") % 31).cast("double").alias("fps"), (F.col("video_id") % 400 + 1).alias("frame_count"))


_RANGES = """lines AS (SELECT l_orderkey AS video_id, l_linenumber, l_partkey, l_quantity * 7.5 AS a, l_partkey % 500 + 0.5 AS b,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity * 7.5) - 1 AS shot_id,
    l_orderkey % 400 + 1 AS n, CASE WHEN l_orderkey % 31 <= 0 THEN 25.0::DOUBLE ELSE (l_orderkey % 31)::DOUBLE END AS fps FROM lineitem),
frames AS (SELECT *, greatest(0, least(CAST(round_even(a, 0) AS BIGINT), n - 1)) AS x, greatest(0, least(CAST(round_even(b, 0) AS BIGINT), n - 1)) AS y FROM lines)"""


@query(f"""WITH {_RANGES} SELECT video_id, CAST(shot_id AS BIGINT) AS shot_id, least(x, y) AS start_frame, greatest(x, y) AS end_frame,
  CAST(round_even(least(x, y) * 1000.0::DOUBLE / fps, 0) AS BIGINT) AS start_ms, CAST(round_even(greatest(x, y) * 1000.0::DOUBLE / fps, 0) AS BIGINT) AS end_ms FROM frames""")
def normalize_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.normalise_ranges(shots.video_meta(_ranges(spark, sf_dir))).select("video_id", "shot_id", "start_frame", "end_frame", "start_ms", "end_ms")


@query("""SELECT l_orderkey AS k, l_linenumber AS n, CAST(round_even(l_partkey * 1000.0::DOUBLE / (l_orderkey % 60 + 0.5)::DOUBLE, 0) AS BIGINT) AS ms FROM lineitem""")
def frame_to_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = (F.col("l_orderkey") % 60).cast("double") + 0.5
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), sampling.frame_to_ms(F.col("l_partkey"), fps).alias("ms"))


@query("""SELECT o_orderkey AS video_id, 0::BIGINT AS shot_id, 0::BIGINT AS start_frame, o_custkey AS end_frame, CAST(round_even(o_custkey * 1000.0::DOUBLE / 25.0, 0) AS BIGINT) AS end_ms FROM orders""")
def whole_video_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<array<double>>")
    videos = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), F.lit(0.0).alias("fps"), (F.col("o_custkey") + 1).alias("frame_count"), none.alias("ranges"))
    return shots.normalise_ranges(shots.video_meta(videos)).select("video_id", "shot_id", "start_frame", "end_frame", "end_ms")


@query("""SELECT p_partkey, CASE WHEN m <= 512 THEN w ELSE greatest(1, CAST(round_even(w * (512 / m::DOUBLE), 0) AS BIGINT)) END AS width,
  CASE WHEN m <= 512 THEN h ELSE greatest(1, CAST(round_even(h * (512 / m::DOUBLE), 0) AS BIGINT)) END AS height
FROM (SELECT *, greatest(w, h) AS m FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * 40 AS w, CAST(floor(p_retailprice) AS BIGINT) AS h FROM part))""")
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = sampling.fit_within(F.col("p_size").cast("long") * 40, F.floor("p_retailprice"), 512)
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


# -- identifiers and paths ----------------------------------------------------------------------------

_IDS = """(SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'V3C1_' || lpad(c_custkey::VARCHAR, 5, '0') WHEN 1 THEN 'v3c2_' || c_custkey WHEN 2 THEN 'v3c3_' || c_custkey ELSE 'clip' || c_custkey END AS video_id,
  CASE WHEN c_custkey % 3 = 0 THEN '/hint/' || c_custkey || '.mp4' END AS hint FROM customer)"""


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = (F.when(key % 4 == 0, F.concat(F.lit("V3C1_"), F.lpad(key.cast("string"), 5, "0"))).when(key % 4 == 1, F.concat(F.lit("v3c2_"), key))
            .when(key % 4 == 2, F.concat(F.lit("v3c3_"), key)).otherwise(F.concat(F.lit("clip"), key)))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("video_id"), F.when(key % 3 == 0, F.concat(F.lit("/hint/"), key, F.lit(".mp4"))).alias("hint"))


@query(f"""SELECT video_id, CASE WHEN regexp_matches(lower(video_id), '^v3c[12]_[0-9]+$') THEN 'V3C' || regexp_extract(lower(video_id), '^v3c([12])_', 1) END AS collection,
  CASE WHEN regexp_matches(lower(video_id), '^v3c[12]_[0-9]+$') THEN regexp_extract(video_id, '_([0-9]+)$', 1) END AS short_id FROM {_IDS}""")
def video_id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("video_id", paths.video_id_parts(F.col("video_id")).alias("p")).select("video_id", "p.collection", "p.short_id")


@query(f"""WITH c AS (SELECT *, regexp_matches(lower(video_id), '^v3c[12]_[0-9]+$') AS known, 'V3C' || regexp_extract(lower(video_id), '^v3c([12])_', 1) AS col, regexp_extract(video_id, '_([0-9]+)$', 1) AS s FROM {_IDS}),
p AS (SELECT *, CASE WHEN hint IS NOT NULL THEN [hint] ELSE []::VARCHAR[] END || CASE WHEN known THEN ['/root/' || col || '/videos/' || s || '/' || s || '.mp4', '/root/videos/' || s || '/' || s || '.mp4',
  '/root/' || s || '/' || s || '.mp4', '/root/' || col || '/' || s || '.mp4'] ELSE []::VARCHAR[] END || ['/root/' || video_id || '.mp4', '/root/' || video_id || '/' || video_id || '.mp4'] AS options FROM c),
e AS (SELECT video_id, options, hint, unnest(options) AS path, generate_subscripts(options, 1) AS pos FROM p),
m AS (SELECT video_id, min(pos) AS pos FROM e WHERE length(path) % 5 = 1 GROUP BY video_id)
SELECT p.video_id, CASE WHEN m.pos IS NOT NULL THEN options[m.pos] WHEN hint IS NOT NULL AND len(options) > 1 THEN options[2] ELSE options[1] END AS path, m.pos IS NOT NULL AS "exists" FROM p LEFT JOIN m USING (video_id)""")
def resolve_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that exist are, here, those whose path has a length of 1 modulo 5."""
    from framesift.sources.videos import resolve_paths

    ids = _ids(spark, sf_dir)
    options = ids.select(F.explode(paths.path_candidates("/root", F.col("video_id"), F.col("hint"))).alias("path")).distinct()
    return resolve_paths(ids, options.where(F.length("path") % 5 == 1), "/root", hint="hint").select("video_id", "path", "exists")


# -- partitions, cursors, resuming --------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def partition_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.take_partition(table(spark, sf_dir, "orders"), 1, 3, "o_orderkey").select("o_orderkey")


@query("SELECT c_custkey AS total, i, (c_custkey + 7 - 1 - i) // 7 AS size FROM customer, (SELECT unnest(range(0, 7)) AS i)")
def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("i"))
    return rows.select("total", "i", partition.partition_size(F.col("total"), F.col("i"), F.lit(7).cast("long")).alias("size"))


@query("SELECT event_id, user_id FROM events WHERE event_id > 500 AND event_id % 2 = 0")
def cursor_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = partition.after_cursor(table(spark, sf_dir, "events"), 500, "event_id")
    return partition.take_partition(rows, 0, 2, "event_id").select("event_id", "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return partition.without_done(table(spark, sf_dir, "orders"), done, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return partition.without_done(table(spark, sf_dir, "part"), there, ["p_partkey"]).select("p_partkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.first_rows(table(spark, sf_dir, "orders").select("o_orderkey"), 25, ["o_orderkey"])


@query("""SELECT doc_id, source, n_chars, CAST(row_number() OVER (ORDER BY source NULLS FIRST, n_chars NULLS FIRST, doc_id) - 1 AS BIGINT) AS position FROM documents""")
def number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their texts, numbered in the order of three columns."""
    out = manifest.number_rows(table(spark, sf_dir, "documents"), ["source", "n_chars", "doc_id"], "position")
    return out.where(F.length("text") >= 0).select("doc_id", "source", "n_chars", "position")


# -- retrieval ----------------------------------------------------------------------------------------


@query(f"""SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS unit
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:{DIMENSION}] AS v FROM embeddings)""")
def truncate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.prepare(F.col("embedding"), DIMENSION).alias("unit"))


@query(f"WITH {_retrieval_sql(1)} SELECT task_id, source_index, score FROM scored")
def dot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.score_pairs(_tasks(spark, sf_dir), _frames(spark, sf_dir)).select("task_id", "source_index", "score")


_TOP = "SELECT task_id, shot_uid, source_index, CAST(round(score * 1e9) AS BIGINT) AS score_e9, rank FROM cand"


def _top(spark: SparkSession, sf_dir: str, k: int, dimension: int | None) -> DataFrame:
    """Matrix products sum in another order than SQL: scores are compared to nine digits."""
    found = topk.retrieve(_tasks(spark, sf_dir, dimension), _frames(spark, sf_dir, dimension), k)
    return found.select("task_id", "shot_uid", "source_index", F.round(F.col("score") * 1e9).cast("long").alias("score_e9"), "rank")


@query(f"WITH {_retrieval_sql(20, DIMENSION)} {_TOP}")
def topk_unique_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 20, DIMENSION)


@query(f"WITH {_retrieval_sql(3000)} {_TOP}")
def topk_large_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 3000, None)


@query(f"""WITH {_retrieval_sql(3000)}, r AS (SELECT task_id, video_id, shot_id % 3 AS shot_id, rank FROM cand),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY task_id, video_id, shot_id ORDER BY rank) = 1)
SELECT task_id, video_id, shot_id, rank, row_number() OVER (PARTITION BY task_id ORDER BY rank) AS position FROM u QUALIFY position <= 30""")
def top_unique_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.retrieve(_tasks(spark, sf_dir), _frames(spark, sf_dir), 3000).select("task_id", "video_id", (F.col("shot_id") % 3).alias("shot_id"), "rank")
    return rerank.unique_shots(found, 30)


@query("""SELECT (SELECT count(*) FROM embeddings) AS embedded, (SELECT count(DISTINCT len(embedding)) FROM embeddings) AS dimensions,
  (SELECT count(DISTINCT vec_id // 64) FROM embeddings) AS shards""")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(
        F.count("*").alias("embedded"), F.countDistinct(F.size("embedding")).alias("dimensions"), F.countDistinct(sampling.div(F.col("vec_id"), 64)).alias("shards"))


@query("""SELECT vec_id // 64 AS index, count(*) AS count, min(vec_id) AS first_source_index, max(vec_id) AS last_source_index FROM embeddings GROUP BY 1""")
def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.sources.corpus import shard_table

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_index"), sampling.div(F.col("vec_id"), 64).alias("index"))
    return shard_table(rows)


# -- second stage -------------------------------------------------------------------------------------


@query(_rerank_sql("SELECT task_id, video_id, shot_id, shot_start_ms, shot_end_ms, position FROM bounds"))
def shot_bounds_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rerank(spark, sf_dir).candidates.select("task_id", "video_id", "shot_id", "shot_start_ms", "shot_end_ms", "position")


@query(_rerank_sql("SELECT task_id, shot_uid, frame_ms, sample, reranker_score FROM per_shot"))
def coarse_best_per_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.best_per_shot(_rerank(spark, sf_dir).coarse).select("task_id", "shot_uid", "frame_ms", "sample", "reranker_score")


@query(_rerank_sql("SELECT task_id, shot_uid, frame_ms, center_rank FROM centers"))
def fine_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rerank(spark, sf_dir).centers.select("task_id", "shot_uid", "frame_ms", "center_rank")


@query(_rerank_sql("SELECT task_id, shot_uid, frame_ms, center AS fine_center_ms FROM fine"))
def fine_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rerank(spark, sf_dir).fine.select("task_id", "shot_uid", "frame_ms", "fine_center_ms")


@query(_rerank_sql("SELECT task_id, rank, shot_uid, frame_ms, CASE WHEN isf = 1 THEN 'fine' ELSE 'coarse' END AS scan_stage, reranker_score FROM ranked WHERE rank <= 500"))
def final_ranked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rerank(spark, sf_dir).ranked.where("rank <= 500").select("task_id", "rank", "shot_uid", "frame_ms", "scan_stage", "reranker_score")


@query(_rerank_sql("""SELECT task_id, video_id, frame_ms, row_number() OVER (PARTITION BY task_id ORDER BY rank) AS place
FROM (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY task_id, video_id ORDER BY rank) = 1) QUALIFY place <= 10"""))
def distinct_on_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = rerank.numbered(_rerank(spark, sf_dir).ranked, ["task_id", "video_id"], ["rank"], "_n", 1)
    return rerank.numbered(first, ["task_id"], ["rank"], "place", 10).select("task_id", "video_id", "frame_ms", "place")


@query(_rerank_sql("SELECT * FROM selected WHERE stage = 1", 30))
def fallback_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rerank(spark, sf_dir, 30).selected.where("stage = 1")


@query(_rerank_sql("SELECT * FROM selected"))
def rerank_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rerank(spark, sf_dir).selected


@query(_rerank_sql("""SELECT task_id, (SELECT count(*) FROM bounds b WHERE b.task_id = t.task_id) AS candidate_shots, (SELECT count(*) FROM coarse b WHERE b.task_id = t.task_id) AS coarse_frames,
(SELECT count(*) FROM centers b WHERE b.task_id = t.task_id) AS fine_centers, (SELECT count(*) FROM fine b WHERE b.task_id = t.task_id) AS fine_frames FROM (SELECT DISTINCT task_id FROM bounds) t"""))
def rerank_task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rerank(spark, sf_dir).stats


@query(_rerank_sql("""SELECT task_id, to_json(list({'rank': rank, 'video_id': video_id, 'frame_ms': frame_ms} ORDER BY rank))::VARCHAR AS results FROM selected GROUP BY task_id"""))
def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.nested_results(_rerank(spark, sf_dir).selected).select("task_id", text.as_json(F.col("results")).alias("results"))


# -- sinks, read back ---------------------------------------------------------------------------------


@query("""SELECT CAST(item_id AS VARCHAR) AS task_id, text AS description, CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS task_pos FROM benchmark""")
def tasks_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks written as JSON lines in several files, and loaded in their order."""
    path = scratch(spark, "tasks")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("description"), "item_id")
    sinks.write_jsonl(rows.repartitionByRange(4, "item_id").sortWithinPartitions("item_id").drop("item_id"), path)
    return tables.load_tasks(spark, path).select("task_id", "description", "task_pos")


@query(f"WITH {_retrieval_sql(500)} SELECT task_id, rank AS position, rank, video_id, shot_id, CAST(round(score * 1e9) AS BIGINT) AS score_e9 FROM cand")
def candidates_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate lists, one JSON object a task, and loaded again."""
    path = scratch(spark, "candidates")
    sinks.write_candidates(topk.retrieve(_tasks(spark, sf_dir), _frames(spark, sf_dir), LIMIT), path)
    rows = tables.load_candidates(spark, path)
    return rows.select("task_id", "position", "rank", "video_id", "shot_id", F.round(F.col("score") * 1e9).cast("long").alias("score_e9"))


@query(_rerank_sql("SELECT task_id, rank, shot_id, frame_ms, reranker_score FROM ranked WHERE rank <= 500"))
def ranked_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked frames, a partition a task, written twice: the second time replaces the first."""
    path, ranked = scratch(spark, "ranked"), _rerank(spark, sf_dir).ranked
    for _ in range(2):
        sinks.write_ranked(ranked.select("task_id", "shot_id", "frame_ms", "reranker_score", "rank"), path)
    return spark.read.schema("rank long, shot_id long, frame_ms long, reranker_score double, task_id string").parquet(path)


@query(_rerank_sql("""SELECT CAST(dense_rank() OVER (ORDER BY CAST(task_id[2:] AS BIGINT)) - 1 AS BIGINT) AS position, task_id, rank, video_id, frame_ms FROM selected"""))
def submission_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission as one JSON document in the order of the tasks, and read again."""
    path = scratch(spark, "submission")
    tasks = manifest.number_rows(_tasks(spark, sf_dir).select("task_id"), [F.substring("task_id", 2, 19).cast("long")], "task_pos")
    results = rerank.nested_results(_rerank(spark, sf_dir).selected)
    sinks.write_submission(merge.merge([results], tasks), path)
    return tables.read_submission(spark, f"{path}/submission.json").select("position", "task_id", F.inline("results"))


@query("""SELECT doc_id, CASE WHEN n_chars < 300 THEN 'too short' END AS error FROM documents""")
def failures_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an error go to a table of their own."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 300, F.lit("too short")).alias("error"))
    good, bad = sinks.split_failures(rows)
    path = scratch(spark, "failures")
    good.write.parquet(f"{path}/good")
    bad.write.parquet(f"{path}/bad")
    return spark.read.parquet(f"{path}/good").withColumn("error", F.lit(None).cast("string")).unionByName(spark.read.parquet(f"{path}/bad"))


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 > 0 THEN c_name END, ''), 'v' || c_custkey) AS video_id FROM customer""")
def or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, F.lit("")).when(key % 7 > 0, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.or_default(name, F.concat(F.lit("v"), key)).alias("video_id"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS top FROM e)
SELECT vec_id AS source_index, len(v) AS n, top < 65504 AS fits FROM m""")
def half_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written with 16 bits a component and read again: as many components, none off by more than 16 bits lose."""
    path = scratch(spark, "half")
    sinks.write_frames(_frames(spark, sf_dir).select("source_index", "embedding"), f"{path}/frames", 512, half=True)
    back = corpus.vectors(spark.read.parquet(f"{path}/frames")).select("source_index", F.col("embedding").alias("w"))
    both = back.join(_frames(spark, sf_dir).select("source_index", "embedding"), "source_index")
    off = F.aggregate(F.zip_with("w", "embedding", lambda a, b: F.abs(a - b) <= F.abs(b) / 1024 + 1e-7), F.lit(True), lambda t, x: t & x)
    return both.select("source_index", F.size("w").cast("long").alias("n"), off.alias("fits"))


# -- merging and checks -------------------------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_custkey").alias("task_pos"), "c_acctbal")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), "o_orderkey", "o_orderstatus")
    return tasks, merge.union_all([orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")])


@query("SELECT c_custkey AS task_id, c_custkey AS task_pos FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def merge_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts hold what was finished (status F)."""
    tasks, parts = _parts(spark, sf_dir)
    return merge.missing(tasks.select("task_id", "task_pos"), parts.where("o_orderstatus = 'F'").select("task_id", "o_orderkey"))


@query("SELECT DISTINCT o_custkey AS task_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def merge_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, parts = _parts(spark, sf_dir)
    return merge.extra(tasks.where("c_acctbal > 0").select("task_id", "task_pos"), parts)


@query("SELECT o_custkey AS task_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.duplicates(_parts(spark, sf_dir)[1])


@query("SELECT o_custkey AS task_id, o_orderkey, c_custkey AS task_pos FROM orders JOIN customer ON c_custkey = o_custkey")
def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, parts = _parts(spark, sf_dir)
    return merge.in_task_order(parts.drop("o_orderstatus"), tasks.drop("c_acctbal"))


@query("""WITH e AS (SELECT vec_id, vec_id // 10 - CASE WHEN vec_id // 10 % 19 = 18 THEN 1 ELSE 0 END AS task FROM embeddings),
r AS (SELECT 'T' || task AS task_id, row_number() OVER (PARTITION BY task ORDER BY vec_id) + CASE WHEN task % 13 = 2 THEN 1 ELSE 0 END AS rank,
  CASE WHEN task % 5 = 0 THEN vec_id // 3 ELSE vec_id END AS video, vec_id % 41 = 0 AS blank, CASE WHEN vec_id % 53 = 0 THEN -1 ELSE vec_id END AS frame_ms FROM e),
v AS (SELECT *, CASE WHEN blank THEN '' ELSE 'v' || video END AS video_id FROM r)
SELECT task_id, 'more than 10 results' AS fault FROM v GROUP BY task_id HAVING count(*) > 10
UNION SELECT task_id, 'ranks are not 1 to n' FROM v GROUP BY task_id HAVING min(rank) <> 1 OR max(rank) <> count(*)
UNION SELECT task_id, 'invalid video_id' FROM v WHERE video_id = ''
UNION SELECT task_id, 'duplicate video_id' FROM v GROUP BY task_id, video_id HAVING count(*) > 1
UNION SELECT task_id, 'frame_ms is negative' FROM v WHERE frame_ms < 0
UNION SELECT task_id, 'unknown video_id' FROM v WHERE video_id <> '' AND video % 29 = 7""")
def validate_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as results, ten a task (every 19th task twenty); every 29th video is unknown."""
    task = sampling.div(F.col("vec_id"), 10) - F.when(sampling.div(F.col("vec_id"), 10) % 19 == 18, 1).otherwise(0)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", task.alias("task"))
    rank = F.row_number().over(Window.partitionBy("task").orderBy("vec_id")).cast("long") + F.when(F.col("task") % 13 == 2, 1).otherwise(0)
    number = F.when(F.col("task") % 5 == 0, sampling.div(F.col("vec_id"), 3)).otherwise(F.col("vec_id"))
    video = F.when(F.col("vec_id") % 41 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), number))
    frame = F.when(F.col("vec_id") % 53 == 0, F.lit(-1).cast("long")).otherwise(F.col("vec_id"))
    results = rows.select(F.concat(F.lit("T"), "task").alias("task_id"), rank.alias("rank"), video.alias("video_id"), frame.alias("frame_ms"))
    known = rows.select(F.explode(F.array("vec_id", sampling.div(F.col("vec_id"), 3))).alias("n")).distinct().where("n % 29 <> 7")
    return validate.result_faults(results, known.select(F.concat(F.lit("v"), "n").alias("video_id")))


@query("""WITH t AS (SELECT CASE item_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'same' ELSE CAST(item_id AS VARCHAR) END AS task_id, CASE WHEN item_id % 7 = 0 THEN '' ELSE text END AS description FROM benchmark)
SELECT task_id, 'task without task_id' AS fault FROM t WHERE task_id = ''
UNION ALL SELECT task_id, 'duplicate task_id' FROM t WHERE task_id <> '' GROUP BY task_id HAVING count(*) > 1
UNION ALL SELECT task_id, 'task without description' FROM t WHERE task_id <> '' AND description = ''""")
def task_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    name = F.when(item % 9 == 0, F.lit("")).when(item % 9 == 1, F.lit("same")).otherwise(item.cast("string"))
    tasks = table(spark, sf_dir, "benchmark").select(name.alias("task_id"), F.when(item % 7 == 0, F.lit("")).otherwise(F.col("text")).alias("description"))
    return validate.task_faults(tasks)


# -- progress and text --------------------------------------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a user: seconds and events so far; every third event repeats the time before it."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.timestamp_diff("MILLISECOND", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1000.0).alias("at"))
    return rows.withColumn("completed", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id")).cast("long"))


_SAMPLES = """s AS (SELECT user_id, event_id, date_diff('millisecond', TIMESTAMP '2000-01-01 00:00:00', ts) / 1000.0::DOUBLE AS sec FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS completed FROM s),
d AS (SELECT *, sec - first(sec) OVER w AS dt, completed - first(completed) OVER w AS dn FROM n WINDOW w AS (PARTITION BY user_id ORDER BY sec, completed ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CASE WHEN dt > 0 AND dn > 0 THEN dn / dt END AS rate FROM d)"""


@query(f"WITH {_SAMPLES} SELECT user_id, event_id, completed, rate FROM r")
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.rolling_rate(_samples(spark, sf_dir), 8, key="user_id").select("user_id", "event_id", "completed", "rate")


@query(f"""WITH {_SAMPLES}, t AS (SELECT *, 100 AS total, least(completed, 100) AS c, greatest(sec - min(sec) OVER (PARTITION BY user_id), 0.0) AS elapsed_seconds FROM r)
SELECT user_id, event_id, c AS completed, c / total::DOUBLE * 100 AS percent, CASE WHEN total - c <= 0 THEN 0.0 WHEN rate IS NOT NULL THEN (total - c) / rate END AS eta_seconds, elapsed_seconds FROM t""")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = progress.rolling_rate(_samples(spark, sf_dir), 8, key="user_id").withColumn("total", F.lit(100).cast("long"))
    return progress.snapshot(rated, key="user_id").select("user_id", "event_id", "completed", "percent", "eta_seconds", "elapsed_seconds")


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -1.0 ELSE (event_id * event_id % 200003) + 0.5 END AS x FROM events),
w AS (SELECT *, CAST(round_even(x, 0) AS BIGINT) AS t FROM s)
SELECT event_id, CASE WHEN x IS NULL OR x < 0 THEN '--' WHEN t // 86400 > 0 THEN printf('%dd %02dh %02dm', t // 86400, t % 86400 // 3600, t % 3600 // 60)
  WHEN t // 3600 > 0 THEN printf('%dh %02dm', t // 3600, t % 3600 // 60) WHEN t // 60 > 0 THEN printf('%dm %02ds', t // 60, t % 60) ELSE printf('%ds', t) END AS duration FROM w""")
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    seconds = F.when(key % 11 == 0, F.lit(None).cast("double")).when(key % 13 == 0, F.lit(-1.0)).otherwise((key * key % 200003) + 0.5)
    return table(spark, sf_dir, "events").select("event_id", text.format_duration(seconds).alias("duration"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.sha256(F.col("text").cast("binary")).alias("sha256"))


@query("""SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS parts FROM lineitem GROUP BY l_orderkey""")
def unique_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("p")).select("l_orderkey", sampling.unique_ints(F.col("p")).alias("parts"))


@query("""SELECT CASE WHEN l_quantity <= 0 THEN 'skipped' WHEN l_quantity > 45 THEN 'failed' ELSE 'completed' END AS status, count(*) AS count FROM lineitem GROUP BY 1""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_quantity") <= 0, "skipped").when(F.col("l_quantity") > 45, "failed").otherwise("completed")
    return table(spark, sf_dir, "lineitem").groupBy(status.alias("status")).agg(F.count("*").alias("count"))
