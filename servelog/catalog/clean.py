"""Queries of 2B: scalar columns, validation, steady state."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelog.catalog import sql, views
from servelog.catalog.common import r6
from servelog.functions.keys import block_chain, hash_api_key, prefix_key
from servelog.operators import clean, metrics


def validate_requests(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).withColumn("input", F.col("props"))
    return clean.validate_requests(rows).select(
        "seq", "is_valid", F.array_join("reasons", ",").alias("reasons"))


def normalise_params(spark, sf_dir):
    raw = views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", '"k"', '"max_tokens"'))
        .otherwise(F.col("props")).alias("params"))
    return clean.normalise_params(raw).select("seq", "p.*")


def prefix_keys(spark, sf_dir):
    return views.prompt_log(spark, sf_dir).select(
        "seq", prefix_key("text").alias("prefix_key"), prefix_key("text", 32).alias("prefix_key_32"))


def block_chains(spark, sf_dir):
    return block_chain(views.prompt_log(spark, sf_dir), "text", views.BLOCK_CHARS)


def api_key_hashes(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), hash_api_key("user_id").alias("key_hash"))


def resolved_payloads(spark, sf_dir):
    rows = views.token_log(spark, sf_dir).select(
        "job_id", "seq", F.when(F.col("role") == "system", F.col("token")).alias("error"),
        F.when(F.col("role") == "assistant", F.col("token")).alias("token"),
        F.when(F.col("final"), F.col("token")).alias("output"))
    return clean.resolve_payload(rows).select("job_id", "seq", "kind", "payload")


def deadlines(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select(
        "seq", "priority", (F.col("ts_us") / 1000.0).alias("enqueue_ms"), "queue_wait_ms")
    now = F.col("enqueue_ms") + F.col("queue_wait_ms")
    return clean.deadline_columns(rows, now).select(
        "seq", F.round("deadline", 3).alias("deadline"), F.round("slack", 3).alias("slack"),
        (F.round("slack", 3) <= 0).alias("overdue"))


def depth_events(spark, sf_dir, by=("model", "priority")):
    rows = views.request_log(spark, sf_dir)
    # One row per ~4 minutes: a wait of k ms stands for k minutes.
    leave = F.col("ts_us") + F.col("prefix_id").cast("long") * 60_000_000
    return metrics.step_events(rows, [*by, "seq"], F.col("ts_us"), leave)


def admission_classes(spark, sf_dir):
    events = depth_events(spark, sf_dir, ())
    depth = metrics.queue_depth(events, [])
    return clean.admission_class(depth.where("delta > 0"), 10, 15).select("seq", "depth", "admission")


def steady_state_rows(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("seq", "worker_id", "status", "total_ms")
    kept = clean.steady_state(rows, 250, ["worker_id"], completed=F.col("status") == "done")
    return kept.select("seq", "worker_id", "arrival_index", r6("total_ms"))


QUERIES = {f.__name__: f for f in (
    validate_requests, normalise_params, prefix_keys, block_chains, api_key_hashes,
    resolved_payloads, deadlines, admission_classes, steady_state_rows)}

DEPTH_EVENTS = sql.REQUEST_LOG + """,
depth_events AS (
  SELECT model, priority, seq, ts_us AS t_us, 0 AS phase, 1 AS delta FROM request_log
  UNION ALL
  SELECT model, priority, seq, ts_us + prefix_id::BIGINT * 60000000,
    CASE WHEN prefix_id > 0 THEN -1 ELSE 1 END, -1 FROM request_log)"""

SQL = {
    "validate_requests": sql.with_(sql.REQUEST_LOG) + """
SELECT seq, reasons = '' AS is_valid, reasons FROM (
  SELECT seq, concat_ws(',',
    CASE WHEN model IS NULL THEN 'model' END, CASE WHEN props IS NULL THEN 'input' END,
    CASE WHEN max_tokens NOT BETWEEN 1 AND 8192 THEN 'max_tokens' END,
    CASE WHEN temperature NOT BETWEEN 0 AND 2 THEN 'temperature' END,
    CASE WHEN top_p NOT BETWEEN 0 AND 1 THEN 'top_p' END,
    CASE WHEN mode NOT IN ('sync', 'async') THEN 'mode' END,
    CASE WHEN priority NOT IN ('high', 'default') THEN 'priority' END) AS reasons
  FROM request_log)""",
    "normalise_params": """
SELECT event_id AS seq,
  CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER)
    ELSE 128 END AS max_tokens,
  0.7::DOUBLE AS temperature, 1.0::DOUBLE AS top_p, false AS stream FROM events""",
    "prefix_keys": """
SELECT doc_id AS seq, md5(substr(text, 1, 512)) AS prefix_key,
  md5(substr(text, 1, 32)) AS prefix_key_32 FROM documents""",
    "block_chains": sql.with_(sql.CHAINS, recursive=True) + """
SELECT seq, depth, chain_hash FROM chains""",
    "api_key_hashes": "SELECT event_id AS seq, sha256(user_id::VARCHAR) AS key_hash FROM events",
    "resolved_payloads": sql.with_(sql.TOKEN_LOG) + """
SELECT job_id, seq,
  CASE WHEN role = 'system' THEN 'error' WHEN role = 'assistant' THEN 'token'
    ELSE 'output' END AS kind,
  CASE WHEN role IN ('system', 'assistant') OR final THEN token ELSE '' END AS payload
FROM token_log""",
    "deadlines": sql.with_(sql.REQUEST_LOG) + """
SELECT seq, round(enqueue_ms + budget, 3) AS deadline,
  round(enqueue_ms + budget - (enqueue_ms + queue_wait_ms), 3) AS slack,
  round(enqueue_ms + budget - (enqueue_ms + queue_wait_ms), 3) <= 0 AS overdue
FROM (SELECT *, ts_us / 1000.0::DOUBLE AS enqueue_ms,
        CASE priority WHEN 'high' THEN 5.0::DOUBLE ELSE 50.0::DOUBLE END AS budget
      FROM request_log)""",
    "admission_classes": sql.with_(DEPTH_EVENTS) + """
SELECT seq, depth, CASE WHEN depth >= 15 THEN 'shed' WHEN depth >= 10 THEN 'degraded'
  ELSE 'accept' END AS admission
FROM (SELECT seq, delta, CAST(sum(delta) OVER (ORDER BY t_us, phase, seq
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM depth_events)
WHERE delta > 0""",
    "steady_state_rows": sql.with_(sql.REQUEST_LOG) + """
SELECT seq, worker_id, i AS arrival_index, round(total_ms, 6) AS total_ms
FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY seq) - 1 AS i
      FROM request_log) WHERE i >= 250 AND status = 'done'""",
}
