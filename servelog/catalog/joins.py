"""Queries of 2C: lookups, ring joins, longest prefix, un-acked rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelog.catalog import sql, views
from servelog.functions.keys import hash_api_key, prefix_key
from servelog.operators import joins, ring


def authenticated(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("seq", hash_api_key("api_key").alias("key_hash"))
    accepted, rejected = joins.authenticate(rows, views.api_keys(spark, sf_dir))
    none = F.lit(None)
    return (accepted.withColumn("accepted", F.lit(True)).unionByName(
        rejected.withColumns({"tenant_id": none.cast("string"), "rps_limit": none.cast("int"),
                              "accepted": F.lit(False)}))
            .select("seq", "tenant_id", "rps_limit", "accepted"))


def requests_with_batches(spark, sf_dir):
    requests = views.work_log(spark, sf_dir).select(
        F.col("batch_no").alias("batch_id"), "worker_id", "prefix_id", "l_linenumber", "tokens")
    batches = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.length("o_orderpriority").alias("size"),
        (F.col("o_custkey") % 4).alias("worker_id"),
        F.floor("o_totalprice").cast("int").alias("inference_ms"))
    return joins.requests_with_batches(requests, batches)


def models_loaded_on(spark, sf_dir):
    loaded = joins.models_loaded_on(views.supplier_registry(spark, sf_dir))
    return loaded.select("model", F.array_join("workers", ",").alias("workers"))


def capable_workers(spark, sf_dir):
    # m2 lives on one worker; rows of users divisible by 11 ask for a model nobody has.
    rows = views.request_log(spark, sf_dir).select(
        "seq", F.when(F.col("api_key") % 11 == 0, "m9").otherwise(F.col("model")).alias("model"))
    able, unplaceable = joins.capable_workers(rows, views.workers(spark))
    return able.select("seq", "model", "worker_id").unionByName(
        unplaceable.select("seq", "model", F.lit(None).cast("string").alias("worker_id")))


def _keys(spark, sf_dir):
    return (views.prompt_log(spark, sf_dir)
            .select(prefix_key("text").alias("key")).distinct())


def ring_table(spark, sf_dir):
    return ring.ring_table(views.supplier_registry(spark, sf_dir))


def ring_owner(spark, sf_dir):
    rows = views.prompt_log(spark, sf_dir).select("seq", prefix_key("text").alias("key"))
    return ring.ring_owner(rows, ring.ring_table(views.workers(spark))).select(
        "seq", "key", "worker_id")


def ring_preference(spark, sf_dir):
    return ring.ring_preference(_keys(spark, sf_dir), ring.ring_table(views.workers(spark))).select(
        "key", "rank", "worker_id")


def rebalance_report(spark, sf_dir):
    fleet = views.supplier_registry(spark, sf_dir).select("worker_id")
    before = ring.ring_table(fleet.where("worker_id <> 's3'"))
    after = ring.ring_table(fleet)
    report = ring.rebalance_report(_keys(spark, sf_dir), before, after)
    return report.withColumn("fraction_moved", F.round("fraction_moved", 6))


def _served(chains):
    """Paths served before: even documents, on the worker of their language."""
    return chains.where("seq % 2 = 0").select(
        "chain_hash", "worker_id", F.col("seq").alias("last_seq"))


def longest_prefix_match(spark, sf_dir):
    chains = views.prompt_chains_once(spark, sf_dir)
    asks = chains.where("seq % 2 = 1").select("seq", "depth", "chain_hash")
    every = views.prompt_log(spark, sf_dir).where("seq % 2 = 1").select("seq")
    fleet = spark.createDataFrame([("en", 0), ("fr", 1), ("de", 0), ("es", 3)],
                                  "worker_id string, inflight int")
    match = joins.longest_prefix_match(asks, _served(chains), fleet, F.col("inflight") < 3)
    return every.join(match, "seq", "left").select(
        "seq", "worker_id", F.coalesce("matched_blocks", F.lit(0)).alias("matched_blocks"))


def unacked_after(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("request_id", "ts_us", "prefix_id")
    now = F.lit(1_706_000_000_000_000)  # inside the log's time span
    return joins.unacked_after(rows.where(F.col("ts_us") <= now),
                               rows.where("prefix_id % 2 = 0"), now).select("request_id", "ts_us")


QUERIES = {f.__name__: f for f in (
    authenticated, requests_with_batches, models_loaded_on, capable_workers, ring_table,
    ring_owner, ring_preference, rebalance_report, longest_prefix_match, unacked_after)}

_PROMPT_KEYS = "SELECT md5(substr(text, 1, 512)) AS key FROM documents"

SQL = {
    "authenticated": sql.with_(sql.REQUEST_LOG, sql.API_KEYS) + """
SELECT seq, tenant_id, rps_limit, key_hash IS NOT NULL AS accepted
FROM request_log LEFT JOIN api_keys ON sha256(api_key::VARCHAR) = key_hash""",
    "requests_with_batches": """
SELECT l_orderkey AS batch_id, l_suppkey AS worker_id, l_partkey AS prefix_id, l_linenumber,
  l_quantity AS tokens, CAST(length(o_orderpriority) AS INTEGER) AS batch_size,
  o_custkey % 4 AS batch_worker_id, CAST(floor(o_totalprice) AS INTEGER) AS batch_inference_ms
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "models_loaded_on": sql.with_(sql.REGISTRY) + """
SELECT model, string_agg(worker_id, ',' ORDER BY worker_id) AS workers FROM registry GROUP BY model""",
    "capable_workers": sql.with_(sql.REQUEST_LOG, sql.WORKERS) + """
SELECT seq, r.model, worker_id
FROM (SELECT seq, CASE WHEN api_key % 11 = 0 THEN 'm9' ELSE model END AS model FROM request_log) r
LEFT JOIN worker_models w ON r.model = w.model""",
    "ring_table": sql.with_("fleet AS (SELECT 's' || s_suppkey AS worker_id FROM supplier)",
                            sql.ring("fleet")) + "SELECT pos, worker_id FROM ring",
    "ring_owner": sql.with_(sql.WORKERS, sql.ring(), sql.preferences(_PROMPT_KEYS)) + """
SELECT doc_id AS seq, key, worker_id FROM documents
JOIN pref ON key = md5(substr(text, 1, 512)) AND rank = 1""",
    "ring_preference": sql.with_(sql.WORKERS, sql.ring(), sql.preferences(_PROMPT_KEYS)) + """
SELECT key, CAST(rank AS INTEGER) AS rank, worker_id FROM pref""",
    "rebalance_report": sql.with_(
        "fleet AS (SELECT 's' || s_suppkey AS worker_id FROM supplier)",
        "fleet_b AS (SELECT * FROM fleet WHERE worker_id <> 's3')",
        sql.ring("fleet_b", "ring_b"), sql.ring("fleet", "ring_a"),
        sql.preferences(_PROMPT_KEYS, "ring_b", "pb"), sql.preferences(_PROMPT_KEYS, "ring_a", "pa")) + """
SELECT count(*) AS n_keys, count(*) FILTER (b.worker_id <> a.worker_id) AS n_moved,
  round(avg(CASE WHEN b.worker_id <> a.worker_id THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS fraction_moved,
  count(*) FILTER (b.worker_id <> a.worker_id AND a.worker_id <> 's3') AS n_unneeded
FROM pb b JOIN pa a ON a.key = b.key AND a.rank = 1 WHERE b.rank = 1""",
    "longest_prefix_match": sql.with_(sql.CHAINS, recursive=True) + """
, owners AS (SELECT chain_hash, arg_max(worker_id, seq) AS worker_id FROM chains
  WHERE seq % 2 = 0 AND worker_id <> 'es' GROUP BY chain_hash),
best AS (SELECT seq, arg_max(o.worker_id, depth) AS worker_id, max(depth) AS matched_blocks
  FROM chains c JOIN owners o ON c.chain_hash = o.chain_hash WHERE seq % 2 = 1 GROUP BY seq)
SELECT doc_id AS seq, worker_id, coalesce(matched_blocks, 0) AS matched_blocks
FROM documents LEFT JOIN best ON doc_id = seq WHERE doc_id % 2 = 1""",
    "unacked_after": sql.with_(sql.REQUEST_LOG) + """
SELECT request_id, ts_us FROM request_log
WHERE 1706000000000000 - ts_us >= 30000000 AND prefix_id % 2 <> 0
ORDER BY ts_us, request_id LIMIT 64""",
}
