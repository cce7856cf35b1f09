"""Queries of 2A: every source and sink, fed from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelog.catalog import sql, views
from servelog.catalog.common import r6
from servelog.functions.keys import hash_api_key
from servelog.operators import metrics
from servelog.session import scratch_path
from servelog.sources import readers, sinks


def _requests(spark, sf_dir):
    log = views.request_log(spark, sf_dir)
    return log.select(
        F.col("request_id").alias("id"),
        F.concat(F.lit("t"), (F.col("api_key") % 10).cast("string")).alias("tenant_id"), "model",
        F.col("props").alias("params"), "status", "worker_id",
        F.floor(F.col("seq") / 16).cast("string").alias("batch_id"), "prefix_hash",
        (F.col("cached_tokens") > 0).alias("cache_hit"),
        F.col("queue_wait_ms").cast("int").alias("queue_wait_ms"),
        F.floor("inference_ms").cast("int").alias("inference_ms"),
        F.floor("total_ms").cast("int").alias("total_ms"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.lit(60))).alias("completed_at"))


def read_log(spark, sf_dir):
    path = views.saved(_requests(spark, sf_dir), "requests")
    log = readers.read_log(spark, path, "requests")
    return log.select("*", F.unix_micros("created_at").alias("created_us"),
                      F.unix_micros("completed_at").alias("completed_us")).drop("created_at", "completed_at")


def read_log_batches(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("model"),
        (F.col("o_custkey") % 16).cast("int").alias("size"), F.col("o_custkey").cast("string").alias("worker_id"),
        F.floor("o_totalprice").cast("int").alias("inference_ms"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))
    batches = readers.read_log(spark, views.saved(orders, "batches"), "batches")
    return batches.withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


def read_log_api_keys(spark, sf_dir):
    keys = views.request_log(spark, sf_dir).groupBy("api_key").agg(F.min("ts").alias("created_at")).select(
        hash_api_key("api_key").alias("key_hash"),
        F.concat(F.lit("t"), (F.col("api_key") % 10).cast("string")).alias("tenant_id"),
        F.lit(10).alias("rps_limit"), F.col("created_at").cast("timestamp").alias("created_at"))
    table = readers.read_log(spark, views.saved(keys, "api-keys"), "api_keys")
    return table.withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


def read_workers(spark, sf_dir):
    path = views.saved(views.supplier_registry(spark, sf_dir), "workers")
    return readers.read_workers(spark, path).select(
        "worker_id", F.explode("models").alias("model"), "max_batch", "max_concurrent", "free_slots")


def read_request_stream(spark, sf_dir):
    from servelog.streaming.run import drain
    docs = views.table(spark, sf_dir, "documents")
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    wire = docs.select(
        F.format_string("req-%08d", "doc_id").alias("request_id"), F.col("text").alias("input"),
        F.col("lang").alias("model"), F.when(even, F.md5("text")).otherwise("").alias("prefix_hash"),
        F.when(third, F.col("n_chars").cast("int")).alias("max_tokens"),
        F.when(even, 0.2).alias("temperature"), F.when(third, "high").alias("priority"))
    stream = readers.read_request_stream(spark, views.saved(wire, "wire", "json"), "json")
    return drain(stream, "decoded").select("request_id", "prefix_hash", "max_tokens", "temperature",
                                           "top_p", "stream", "priority")


def read_kafka_requests(spark, sf_dir):
    """Records as a Kafka source delivers them, decoded by a stream that is stopped and started
    again from its checkpoint twice; no record is lost or read again."""
    from servelog.streaming.run import replay
    docs = views.table(spark, sf_dir, "documents")
    odd = F.col("doc_id") % 2 == 1
    fields = F.struct(
        F.format_string("req-%08d", "doc_id").alias("request_id"), F.col("text").alias("input"),
        F.col("lang").alias("model"), F.when(odd, F.col("n_chars").cast("int")).alias("max_tokens"),
        F.when(odd, True).alias("stream"))
    wire = docs.select(
        F.col("lang").cast("binary").alias("key"), F.to_json(fields).cast("binary").alias("value"),
        F.lit("requests").alias("topic"), (F.col("doc_id") % 4).cast("int").alias("partition"),
        F.floor(F.col("doc_id") / 4).alias("offset"))
    runs = [F.col("offset") % 3 == k for k in range(3)]
    return replay([wire], runs, lambda raw: readers.decode_kafka_requests(raw).select(
        "request_id", "model", "prefix_hash", "max_tokens", "temperature", "stream", "priority"), "kafka")


def read_calibration(spark, sf_dir):
    """Measurement records with nested [x, y] pairs, at most 500 pairs each."""
    log = views.request_log(spark, sf_dir)
    pair = F.array(F.col("prompt_tokens").cast("double"), F.col("inference_ms"))
    run = F.concat_ws("/", "model", F.floor(F.col("seq") / 500).cast("string"))
    runs = log.groupBy(run.alias("run")).agg(F.collect_list(pair).alias("samples"))
    runs = runs.withColumnRenamed("run", "model")
    path = views.saved(runs.withColumn("source", F.lit("log")), "calibration", "json")
    return readers.read_calibration(spark, path, multi_line=False).select("model", "x", "y")


def write_sweep_csv(spark, sf_dir):
    path = scratch_path(spark, "sweep-csv")
    table = metrics.latency_percentiles(views.request_log(spark, sf_dir), ["model", "status"])
    sinks.write_sweep_csv(table.select("model", "status", "n", r6("p50"), r6("p99")), path)
    back = spark.read.option("header", True).schema(
        "model STRING, status STRING, n LONG, p50 DOUBLE, p99 DOUBLE").csv(path)
    return back


def write_request_log(spark, sf_dir):
    source = _requests(spark, sf_dir)
    stream = spark.readStream.schema(source.schema).parquet(views.saved(source, "results"))
    path, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "log-checkpoint")
    sinks.write_request_log(stream, path, checkpoint).awaitTermination()
    log = spark.read.parquet(path)
    return log.select("id", "model", F.date_format("day", "yyyy-MM-dd").alias("day"), "total_ms")


QUERIES = {f.__name__: f for f in (read_log, read_log_batches, read_log_api_keys, read_workers, read_request_stream, read_kafka_requests,
                                   read_calibration, write_sweep_csv, write_request_log)}

SQL = {
    "read_log": sql.with_(sql.REQUEST_LOG) + """
SELECT request_id AS id, 't' || (api_key % 10) AS tenant_id, model, props AS params, status, worker_id,
  (seq // 16)::VARCHAR AS batch_id, prefix_hash, cached_tokens > 0 AS cache_hit,
  CAST(queue_wait_ms AS INTEGER) AS queue_wait_ms, CAST(floor(inference_ms) AS INTEGER) AS inference_ms,
  CAST(floor(total_ms) AS INTEGER) AS total_ms, ts_us AS created_us, ts_us + 60000000 AS completed_us
FROM request_log""",
    "read_log_batches": """
SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS model, CAST(o_custkey % 16 AS INTEGER) AS size,
  o_custkey::VARCHAR AS worker_id, CAST(floor(o_totalprice) AS INTEGER) AS inference_ms,
  epoch_us(o_orderdate) AS created_us FROM orders""",
    "read_log_api_keys": sql.with_(sql.REQUEST_LOG) + """
SELECT sha256(api_key::VARCHAR) AS key_hash, 't' || (api_key % 10) AS tenant_id,
  CAST(10 AS INTEGER) AS rps_limit, min(ts_us) AS created_us FROM request_log GROUP BY api_key""",
    "read_workers": sql.with_(sql.REGISTRY) + """
SELECT worker_id, model, max_batch, max_concurrent,
  CAST(greatest(0, max_concurrent - inflight) AS INTEGER) AS free_slots FROM registry""",
    "read_request_stream": """
SELECT printf('req-%08d', doc_id) AS request_id,
  CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE md5(substr(text, 1, 512)) END AS prefix_hash,
  CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS INTEGER) ELSE 128 END AS max_tokens,
  CASE WHEN doc_id % 2 = 0 THEN 0.2::DOUBLE ELSE 0.7::DOUBLE END AS temperature,
  1.0::DOUBLE AS top_p, false AS stream,
  CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'default' END AS priority FROM documents""",
    "read_kafka_requests": """
SELECT printf('req-%08d', doc_id) AS request_id, lang AS model, md5(substr(text, 1, 512)) AS prefix_hash,
  CASE WHEN doc_id % 2 = 1 THEN CAST(n_chars AS INTEGER) ELSE 128 END AS max_tokens, 0.7::DOUBLE AS temperature,
  doc_id % 2 = 1 AS stream, 'default' AS priority FROM documents""",
    "read_calibration": sql.with_(sql.REQUEST_LOG) + """
SELECT model || '/' || (seq // 500) AS model, prompt_tokens::DOUBLE AS x,
  inference_ms AS y FROM request_log""",
    "write_sweep_csv": sql.with_(sql.REQUEST_LOG) + """
SELECT model, status, count(*) AS n, round(quantile_cont(total_ms, 0.5), 6) AS p50,
  round(quantile_cont(total_ms, 0.99), 6) AS p99 FROM request_log GROUP BY model, status""",
    "write_request_log": sql.with_(sql.REQUEST_LOG) + """
SELECT request_id AS id, model, strftime(ts, '%Y-%m-%d') AS day,
  CAST(floor(total_ms) AS INTEGER) AS total_ms
FROM request_log""",
}
