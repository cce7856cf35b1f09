"""Queries of 2E: cache locality."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelog.catalog import sql, views
from servelog.catalog.common import r6
from servelog.operators import locality
from servelog.plans.sliced import even_slice
from servelog.session import cut


def first_touch(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("seq", "worker_id", "prefix_hash")
    return locality.first_touch(rows, ["worker_id", "prefix_hash"]).select("seq", "worker_id", "hit")


def lru_hits(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("seq", "worker_id", "prefix_hash")
    return locality.lru_hits(rows, 48).select("seq", "worker_id", "distance", "hit")


def _work_distances(spark, sf_dir):
    rows = views.work_log(spark, sf_dir).select("worker_id", "prefix_id", *views.WORK_ORDER)
    return locality.reuse_distance(rows, "worker_id", "prefix_id", views.WORK_ORDER,
                                   even_slice(rows, "day"))


def work_reuse_distance(spark, sf_dir):
    return (_work_distances(spark, sf_dir).groupBy("worker_id", "distance")
            .agg(F.count(F.lit(1)).alias("n")))


def miss_ratio_curve(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("seq", "worker_id", "prefix_hash")
    far = locality.reuse_distance(rows, "worker_id", "prefix_hash", ["seq"],
                                  F.floor(F.col("seq") / 1_000_000))
    got = locality.miss_ratio_curve(far, (1, 2, 4, 8, 16, 32, 48, 64, 96, 128), ["worker_id"])
    return got.select("worker_id", "capacity", r6("hit_ratio"), r6("miss_ratio"))


def _batches(spark, sf_dir):
    return views.request_log(spark, sf_dir).select(
        "seq", "worker_id", "prefix_id", F.floor(F.col("seq") / 64).cast("long").alias("batch_no"))


def batch_locality(spark, sf_dir):
    return locality.batch_locality(_batches(spark, sf_dir))


def batch_locality_lru(spark, sf_dir):
    return locality.batch_locality(_batches(spark, sf_dir), 48, order=["seq"],
                                   slice_=F.floor(F.col("seq") / 1_000_000))


def work_batch_cost(spark, sf_dir):
    rows = views.work_log(spark, sf_dir).select("worker_id", "batch_no", "prefix_id")
    costs = locality.batch_cost(locality.batch_locality(rows), workers=4, slots=4)
    return costs.select("worker_id", "batch_no", "size", "hits", "distinct_missed",
                        *[r6(c) for c in ("latency_ms", "throughput_rps", "capacity_rps",
                                          "offered_rps")])


def prefix_trie(spark, sf_dir):
    return locality.prefix_trie(views.prompt_paths(spark, sf_dir))


def retained_trie(spark, sf_dir):
    return locality.prefix_trie(views.prompt_paths(spark, sf_dir), 50)


def retained_paths(spark, sf_dir):
    served = views.prompt_log(spark, sf_dir).select("seq", "worker_id", F.md5("text").alias("path_id"))
    return locality.retained_paths(served, 100)


def reuse_depth(spark, sf_dir):
    got = locality.reuse_depth(*_chains_once(spark, sf_dir))
    return got.select("worker_id", "seq", "n_blocks", "reused", r6("reuse_fraction"))


def _chains_once(spark, sf_dir):
    """(chains, lengths) from one evaluation of the block hashes, which take 16 bytes each."""
    paths = cut(views.prompt_paths(spark, sf_dir).select(
        "worker_id", "seq", F.transform("path", F.unhex).alias("path")))
    chains = paths.select("worker_id", "seq", F.posexplode("path").alias("pos", "chain_hash"))
    return (chains.select("worker_id", "seq", (F.col("pos") + 1).alias("depth"), "chain_hash"),
            paths.select("worker_id", "seq", F.size("path").alias("n_blocks")))


def reuse_depth_lru(spark, sf_dir):
    got = locality.reuse_depth_lru(*_chains_once(spark, sf_dir), 2000)
    return got.select("worker_id", "seq", "n_blocks", "reused", r6("reuse_fraction"))


def cache_hit_ratio(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("seq", "worker_id", "model", "prefix_hash")
    hits = locality.first_touch(rows, ["worker_id", "prefix_hash"])
    return locality.cache_hit_ratio(hits, ["worker_id", "model"]).select(
        "worker_id", "model", "hits", "misses", r6("hit_ratio"))


def token_hit_fraction(spark, sf_dir):
    rows = views.request_log(spark, sf_dir)
    got = locality.token_hit_fraction(rows, ["model", "worker_id"], F.col("status") == "done")
    return got.withColumn("token_hit_fraction", F.round("token_hit_fraction", 6))


def workers_per_prefix(spark, sf_dir):
    rows = views.request_log(spark, sf_dir)
    got = locality.workers_per_prefix(rows, ["model"])
    return got.withColumn("workers_per_prefix", F.round("workers_per_prefix", 6))


def workers_per_stem(spark, sf_dir):
    rows = views.prompt_paths(spark, sf_dir).select(
        "worker_id", F.coalesce(locality.stem_of(), "path_id").alias("stem"))
    got = locality.workers_per_prefix(rows, prefix="stem")
    return got.withColumn("workers_per_prefix", F.round("workers_per_prefix", 6))


QUERIES = {f.__name__: f for f in (
    first_touch, lru_hits, work_reuse_distance, miss_ratio_curve, batch_locality,
    batch_locality_lru, work_batch_cost, prefix_trie, retained_trie, retained_paths, reuse_depth, reuse_depth_lru,
    cache_hit_ratio, token_hit_fraction, workers_per_prefix, workers_per_stem)}

_DISTANCES = """
acc AS (SELECT seq, worker_id, prefix_hash, row_number() OVER (PARTITION BY worker_id ORDER BY seq) AS pos
  FROM request_log),
prevs AS (SELECT *, lag(pos) OVER (PARTITION BY worker_id, prefix_hash ORDER BY pos) AS prev FROM acc),
distances AS (
  SELECT c.seq, c.worker_id, CASE WHEN any_value(c.prev) IS NULL THEN NULL ELSE
    count(i.pos) FILTER (i.prev IS NULL OR i.prev < c.prev) END AS distance
  FROM prevs c LEFT JOIN prevs i ON i.worker_id = c.worker_id AND i.pos > c.prev AND i.pos < c.pos
  GROUP BY c.seq, c.worker_id)"""

_BATCHES = """
batches AS (SELECT seq, worker_id, prefix_id, seq // 64 AS batch_no FROM request_log)"""

_TRIE = """
last AS (SELECT lang AS worker_id, md5(text) AS path_id, max(doc_id) AS last_seq FROM documents GROUP BY 1, 2),
kept AS (SELECT * FROM last {qualify}),
path_nodes AS (SELECT DISTINCT p.path_id, c.depth, c.chain_hash, c.parent_hash
  FROM (SELECT doc_id AS seq, md5(text) AS path_id FROM documents) p
  JOIN chains c ON c.seq = p.seq)
SELECT depth, chain_hash, parent_hash, worker_id, count(*) AS refcount, max(last_seq) AS last_seq
FROM kept JOIN path_nodes USING (path_id) GROUP BY ALL"""

SQL = {
    "first_touch": sql.with_(sql.REQUEST_LOG) + """
SELECT seq, worker_id, lag(seq) OVER (PARTITION BY worker_id, prefix_hash ORDER BY seq)
  IS NOT NULL AS hit FROM request_log""",
    "lru_hits": sql.with_(sql.REQUEST_LOG, _DISTANCES) + """
SELECT seq, worker_id, distance, coalesce(distance < 48, false) AS hit FROM distances""",
    "work_reuse_distance": sql.with_(sql.WORK_LOG) + f""",
acc AS (SELECT worker_id, prefix_id, row_number() OVER (PARTITION BY worker_id
  ORDER BY {sql.WORK_ORDER}) AS pos FROM work_log),
prevs AS (SELECT *, lag(pos) OVER (PARTITION BY worker_id, prefix_id ORDER BY pos) AS prev FROM acc),
distances AS (
  SELECT c.worker_id, c.pos, CASE WHEN any_value(c.prev) IS NULL THEN NULL ELSE
    count(i.pos) FILTER (i.prev IS NULL OR i.prev < c.prev) END AS distance
  FROM prevs c LEFT JOIN prevs i ON i.worker_id = c.worker_id AND i.pos > c.prev AND i.pos < c.pos
  GROUP BY c.worker_id, c.pos)
SELECT worker_id, distance, count(*) AS n FROM distances GROUP BY worker_id, distance""",
    "miss_ratio_curve": sql.with_(sql.REQUEST_LOG, _DISTANCES) + """
SELECT worker_id, capacity, round(avg(CASE WHEN distance < capacity THEN 1.0::DOUBLE ELSE 0.0 END), 6)
    AS hit_ratio,
  round(1 - avg(CASE WHEN distance < capacity THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS miss_ratio
FROM distances, (VALUES (1), (2), (4), (8), (16), (32), (48), (64), (96), (128)) AS c(capacity)
GROUP BY worker_id, capacity""",
    "batch_locality": sql.with_(sql.REQUEST_LOG, _BATCHES) + """
SELECT worker_id, batch_no, count(*) AS size, count(*) FILTER (hit) AS hits,
  count(DISTINCT CASE WHEN NOT hit THEN prefix_id END) AS distinct_missed
FROM (SELECT *, batch_no > min(batch_no) OVER (PARTITION BY worker_id, prefix_id) AS hit FROM batches)
GROUP BY worker_id, batch_no""",
    "batch_locality_lru": sql.with_(sql.REQUEST_LOG, _BATCHES) + """
, starts AS (SELECT worker_id, batch_no, min(seq) AS start FROM batches GROUP BY 1, 2),
heads AS (SELECT DISTINCT worker_id, batch_no, prefix_id FROM batches),
looks AS (SELECT h.worker_id, h.batch_no, h.prefix_id, any_value(s.start) AS start, max(b.seq) AS p
  FROM heads h JOIN starts s USING (worker_id, batch_no)
  LEFT JOIN batches b ON b.worker_id = h.worker_id AND b.prefix_id = h.prefix_id
    AND b.batch_no < h.batch_no GROUP BY 1, 2, 3),
res AS (SELECT l.worker_id, l.batch_no, l.prefix_id,
    any_value(l.p) IS NOT NULL AND count(DISTINCT b.prefix_id) < 48 AS hit
  FROM looks l LEFT JOIN batches b ON b.worker_id = l.worker_id AND b.seq > l.p AND b.seq < l.start
  GROUP BY 1, 2, 3)
SELECT worker_id, batch_no, count(*) AS size, count(*) FILTER (hit) AS hits,
  count(DISTINCT CASE WHEN NOT hit THEN prefix_id END) AS distinct_missed
FROM batches JOIN res USING (worker_id, batch_no, prefix_id) GROUP BY worker_id, batch_no""",
    "work_batch_cost": sql.with_(sql.WORK_LOG) + """
SELECT *, round(18.0::DOUBLE + 7.5::DOUBLE * size + 160.0::DOUBLE * distinct_missed, 6) AS latency_ms,
  round(1000.0::DOUBLE * size / (18.0::DOUBLE + 7.5::DOUBLE * size), 6) AS throughput_rps,
  round(16000.0::DOUBLE / 185.5::DOUBLE, 6) AS capacity_rps,
  round(round(0.75::DOUBLE * (16000.0::DOUBLE / 185.5::DOUBLE), 3), 6) AS offered_rps
FROM (SELECT worker_id, batch_no, count(*) AS size, count(*) FILTER (hit) AS hits,
        count(DISTINCT CASE WHEN NOT hit THEN prefix_id END) AS distinct_missed
      FROM (SELECT worker_id, batch_no, prefix_id,
              batch_no > min(batch_no) OVER (PARTITION BY worker_id, prefix_id) AS hit FROM work_log)
      GROUP BY worker_id, batch_no)""",
    "prefix_trie": sql.with_(sql.CHAINS, recursive=True) + "," + _TRIE.format(qualify=""),
    "retained_trie": sql.with_(sql.CHAINS, recursive=True) + "," + _TRIE.format(
        qualify="QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY last_seq DESC) <= 50"),
    "retained_paths": """
SELECT worker_id, path_id, max(seq) AS last_seq
FROM (SELECT lang AS worker_id, doc_id AS seq, md5(text) AS path_id FROM documents)
GROUP BY worker_id, path_id
QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY max(seq) DESC) <= 100""",
    "reuse_depth": sql.with_(sql.CHAINS, recursive=True) + """
, seen AS (SELECT worker_id, seq,
    count(*) FILTER (first < seq) AS reused FROM (
      SELECT *, min(seq) OVER (PARTITION BY worker_id, chain_hash) AS first FROM chains)
  GROUP BY worker_id, seq)
SELECT d.lang AS worker_id, d.doc_id AS seq, length(text) // 64 AS n_blocks,
  coalesce(reused, 0) AS reused,
  CASE WHEN length(text) >= 64 THEN round(coalesce(reused, 0)::DOUBLE / (length(text) // 64), 6)
    ELSE 0.0::DOUBLE END AS reuse_fraction
FROM documents d LEFT JOIN seen ON seen.seq = d.doc_id""",
    "reuse_depth_lru": sql.with_(sql.CHAINS, recursive=True) + """
, acc AS (SELECT worker_id, seq, depth, chain_hash,
    row_number() OVER (PARTITION BY worker_id ORDER BY seq, depth) AS pos FROM chains),
looks AS (SELECT worker_id, seq, depth, min(pos) OVER (PARTITION BY worker_id, seq) AS start,
    lag(pos) OVER (PARTITION BY worker_id, chain_hash ORDER BY pos) AS p FROM acc),
res AS (SELECT l.worker_id, l.seq, l.depth, count(DISTINCT b.chain_hash) < 2000 AS hit
  FROM looks l LEFT JOIN acc b ON b.worker_id = l.worker_id AND b.pos > l.p AND b.pos < l.start
  WHERE l.p IS NOT NULL GROUP BY l.worker_id, l.seq, l.depth),
depths AS (SELECT l.seq, coalesce(min(l.depth) FILTER (NOT coalesce(hit, false)) - 1, max(l.depth)) AS reused
  FROM looks l LEFT JOIN res r ON r.seq = l.seq AND r.depth = l.depth GROUP BY l.seq)
SELECT lang AS worker_id, doc_id AS seq, CAST(length(text) // 64 AS INTEGER) AS n_blocks,
  coalesce(reused, 0)::BIGINT AS reused,
  CASE WHEN length(text) >= 64 THEN round(coalesce(reused, 0)::DOUBLE / (length(text) // 64), 6)
    ELSE 0.0::DOUBLE END AS reuse_fraction
FROM documents LEFT JOIN depths ON depths.seq = doc_id""",
    "cache_hit_ratio": sql.with_(sql.REQUEST_LOG) + """
SELECT worker_id, model, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
  round(avg(CAST(hit AS INTEGER)), 6) AS hit_ratio
FROM (SELECT *, seq > min(seq) OVER (PARTITION BY worker_id, prefix_hash) AS hit FROM request_log)
GROUP BY worker_id, model""",
    "token_hit_fraction": sql.with_(sql.REQUEST_LOG) + """
SELECT model, worker_id, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  round(sum(cached_tokens)::DOUBLE / sum(prompt_tokens)::DOUBLE, 6) AS token_hit_fraction
FROM request_log WHERE prompt_tokens > 0 AND status = 'done' GROUP BY model, worker_id""",
    "workers_per_prefix": sql.with_(sql.REQUEST_LOG) + """
SELECT model, count(*) AS n_prefixes, round(avg(w), 6) AS workers_per_prefix
FROM (SELECT model, prefix_hash, count(DISTINCT worker_id) AS w FROM request_log GROUP BY 1, 2)
GROUP BY model""",
    "workers_per_stem": sql.with_(sql.CHAINS, recursive=True) + """
, named AS (SELECT seq, arg_max(chain_hash, depth) AS stem FROM chains WHERE depth <= 3 GROUP BY seq),
stems AS (SELECT lang AS worker_id, coalesce(stem, md5(text)) AS stem
  FROM documents LEFT JOIN named ON seq = doc_id)
SELECT count(*) AS n_prefixes, round(avg(w), 6) AS workers_per_prefix
FROM (SELECT stem, count(DISTINCT worker_id) AS w FROM stems GROUP BY stem)""",
}
