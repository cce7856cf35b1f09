"""Queries of 2F: aggregations, windows, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelog.catalog import clean as clean_queries
from servelog.catalog import sql, views
from servelog.catalog.common import r6
from servelog.operators import metrics

HOUR_US = 3_600_000_000
DAY_US = views.DAY_US


def _us(name):
    return F.unix_micros(name).alias("window_us")


def request_rate(spark, sf_dir):
    got = metrics.request_rate(views.request_log(spark, sf_dir), "1 hour", by=["status", "model"])
    return got.select(_us("window_start"), "status", "model", "n", r6("rate"))


def request_rate_sliding(spark, sf_dir):
    got = metrics.request_rate(views.request_log(spark, sf_dir), "6 hours", "2 hours", ["status"])
    return got.select(_us("window_start"), "status", "n", r6("rate"))


def latency_percentiles(spark, sf_dir):
    got = metrics.latency_percentiles(views.request_log(spark, sf_dir), ["model"])
    return got.select("model", "n", r6("p50"), r6("p95"), r6("p99"))


def latency_last_day(spark, sf_dir):
    """p99 by model over the last day of the log."""
    rows = views.request_log(spark, sf_dir)
    # 2024-01-30 00:00 UTC: the filter reaches the scan.
    got = metrics.latency_percentiles(rows, ["model"], percentiles={"p99": 0.99},
                                      since=F.col("ts") >= F.lit("2024-01-30").cast("timestamp"))
    return got.select("model", "n", r6("p99"))


def _histogram(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select(
        "model", "status", (F.col("total_ms") / 100).alias("seconds"))
    return metrics.bucket_histogram(rows, ["model", "status"], "seconds")


def bucket_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir).select(
        "model", "status", F.col("le").cast("string").alias("le"), "cumulative",
        r6("total_sum"), "total_count")


def histogram_quantile(spark, sf_dir):
    hist = _histogram(spark, sf_dir)
    return metrics.histogram_quantile(hist, ["model"], 0.95).select("model", r6("quantile"))


def _sizes(spark, sf_dir):
    rows = views.work_log(spark, sf_dir)
    return rows.groupBy("batch_no", "worker_id").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.floor(F.col("day") / 30)).alias("month"))


def batch_size_stats(spark, sf_dir):
    got = metrics.batch_size_stats(_sizes(spark, sf_dir), ["month"])
    return got.select("month", "n", r6("mean_size"), r6("p50"), r6("p95"), "max_size")


def batch_size_distribution(spark, sf_dir):
    return metrics.batch_size_distribution(_sizes(spark, sf_dir), ["month"])


def load_imbalance(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select(
        "model", F.concat(F.lit("w"), (F.col("prefix_id") % 7).cast("string")).alias("worker_id"))
    got = metrics.load_imbalance(rows, 8, ["model"])  # w7 stays idle
    return got.select("model", r6("max_over_mean"), r6("max_over_min"))


def work_load_imbalance(spark, sf_dir):
    rows = views.work_log(spark, sf_dir).select("worker_id", "l_returnflag", "tokens")
    n = views.table(spark, sf_dir, "supplier").count()
    got = metrics.load_imbalance(rows, n, ["l_returnflag"], weight=F.col("tokens"))
    return got.select("l_returnflag", r6("max_over_mean"), r6("max_over_min"))


def utilisation(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select(
        "model", "worker_id", F.col("inference_ms").alias("busy_ms"), F.col("ts_us").alias("start_us"),
        (F.col("ts_us") + F.col("total_ms") * 1000).alias("end_us"))
    got = metrics.utilisation(rows, 4, 4, ["model"])
    return got.select("model", *[r6(c) for c in ("busy_ms", "span_ms", "utilisation",
                                                 "busy_imbalance")])


def throughput(spark, sf_dir):
    rows = views.work_log(spark, sf_dir).select(
        "worker_id", "tokens", F.col("ts_us").alias("enqueue_us"),
        (F.col("ts_us") + F.col("busy_ms") * 1000).alias("completed_us"))
    got = metrics.throughput(rows, ["worker_id"], tokens="tokens")
    return got.select("worker_id", "n", F.round("per_second", 12).alias("per_second"),
                      F.round("tokens_per_second", 10).alias("tokens_per_second"))


def queue_depth(spark, sf_dir):
    events = clean_queries.depth_events(spark, sf_dir)
    return metrics.queue_depth(events, ["model", "priority"]).select(
        "model", "priority", "t_us", "phase", "seq", "depth")


def queue_depth_hourly(spark, sf_dir):
    events = clean_queries.depth_events(spark, sf_dir)
    depth = metrics.queue_depth(events, ["model", "priority"])
    return metrics.depth_per_window(depth, ["model", "priority"], HOUR_US)


def fleet_queue_depth(spark, sf_dir):
    depth = metrics.queue_depth(clean_queries.depth_events(spark, sf_dir, ()), [])
    return metrics.depth_per_window(depth, [], HOUR_US)


def _inflight(spark, sf_dir):
    rows = views.request_log(spark, sf_dir)
    end = F.col("ts_us") + F.round(F.col("inference_ms") * 60_000).cast("long") * 1000
    return metrics.inflight(rows, ["worker_id"], F.col("ts_us"), end)


def inflight(spark, sf_dir):
    return _inflight(spark, sf_dir).select("worker_id", "seq", "t_us", "phase", "depth")


def inflight_peak(spark, sf_dir):
    return metrics.peak(_inflight(spark, sf_dir), ["worker_id"])


def topk_mass(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("prefix_hash")
    return metrics.topk_mass(rows, 8).withColumn("topk_mass", F.round("topk_mass", 6))


def document_topk_mass(spark, sf_dir):
    from servelog.functions.keys import prefix_key
    rows = views.prompt_log(spark, sf_dir).select(prefix_key("text", 32).alias("prefix_hash"))
    return metrics.topk_mass(rows, 8).withColumn("topk_mass", F.round("topk_mass", 6))


def queue_wait_stats(spark, sf_dir):
    got = metrics.queue_wait_stats(views.request_log(spark, sf_dir), ["model"])
    return got.select("model", "n", *[r6(c) for c in ("p50", "p95", "p99", "mean_wait")])


def desired_workers(spark, sf_dir):
    depth = metrics.queue_depth(clean_queries.depth_events(spark, sf_dir, ()), [])
    hourly = metrics.depth_per_window(depth, [], HOUR_US)
    # Hours stand for 15 s steps: the windows of 30 and 120 s span 2 and 8 hours.
    return metrics.desired_workers(hourly, target=2, up_s=2 * 3600, down_s=8 * 3600)


def status_lifecycle(spark, sf_dir):
    got = metrics.status_lifecycle(views.job_events(spark, sf_dir))
    return got.select("status", "n", F.round("mean_ms_in_status", 3).alias("mean_ms_in_status"), r6("share"))


QUERIES = {f.__name__: f for f in (
    request_rate, request_rate_sliding, latency_percentiles, latency_last_day, bucket_histogram,
    histogram_quantile, batch_size_stats, batch_size_distribution, load_imbalance,
    work_load_imbalance, utilisation, throughput, queue_depth, queue_depth_hourly,
    fleet_queue_depth, inflight, inflight_peak, topk_mass, document_topk_mass, queue_wait_stats,
    desired_workers, status_lifecycle)}

_HIST = """
les AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0,
  7.5, 10.0, 'Infinity'::DOUBLE]::DOUBLE[]) AS le),
hist AS (SELECT model, status, le, count(*) FILTER (total_ms / 100 <= le) AS cumulative,
    sum(total_ms / 100) AS total_sum, count(*) AS total_count
  FROM request_log, les GROUP BY model, status, le)"""

_SIZES = """
sizes AS (SELECT batch_no, worker_id, count(*) AS size, min(day // 30) AS month
  FROM work_log GROUP BY batch_no, worker_id)"""

_DEPTH = """
depths AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY model, priority ORDER BY t_us, phase, seq
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth,
  CAST(sum(delta) OVER (ORDER BY t_us, phase, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fleet
  FROM depth_events)"""

_FLEET_HOURS = """
hours AS (SELECT t_us // 3600000000 * 3600000000 AS window_us,
    arg_max(fleet, (t_us, phase, seq)) AS depth FROM depths GROUP BY 1)"""

_INFLIGHT = """
moves AS (
  SELECT worker_id, seq, ts_us AS t_us, 0 AS phase, 1 AS delta FROM request_log UNION ALL
  SELECT worker_id, seq, e, CASE WHEN e > ts_us THEN -1 ELSE 1 END, -1
  FROM (SELECT *, ts_us + CAST(round(inference_ms * 60000) AS BIGINT) * 1000 AS e FROM request_log)),
running AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY worker_id ORDER BY t_us, phase, seq
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM moves)"""


def _pct(value, groups, table, extra=""):
    return f"""
SELECT {groups}, count(*) AS n, round(quantile_cont({value}, 0.5), 6) AS p50,
  round(quantile_cont({value}, 0.95), 6) AS p95, round(quantile_cont({value}, 0.99), 6) AS p99{extra}
FROM {table} GROUP BY {groups}"""


SQL = {
    "request_rate": sql.with_(sql.REQUEST_LOG) + """
SELECT ts_us // 3600000000 * 3600000000 AS window_us, status, model, count(*) AS n,
  round(count(*) / 3600.0::DOUBLE, 6) AS rate FROM request_log GROUP BY 1, 2, 3""",
    "request_rate_sliding": sql.with_(sql.REQUEST_LOG) + """
SELECT (ts_us // 7200000000 - i) * 7200000000 AS window_us, status, count(*) AS n,
  round(count(*) / 21600.0::DOUBLE, 6) AS rate FROM request_log, range(3) AS r(i) GROUP BY 1, 2""",
    "latency_percentiles": sql.with_(sql.REQUEST_LOG) + _pct("total_ms", "model", "request_log"),
    "latency_last_day": sql.with_(sql.REQUEST_LOG) + """
SELECT model, count(*) AS n, round(quantile_cont(total_ms, 0.99), 6) AS p99
FROM request_log WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY model""",
    "bucket_histogram": sql.with_(sql.REQUEST_LOG, _HIST) + """
SELECT model, status, CASE WHEN isinf(le) THEN 'Infinity' ELSE le::VARCHAR END AS le, cumulative,
  round(total_sum, 6) AS total_sum, total_count FROM hist""",
    "histogram_quantile": sql.with_(sql.REQUEST_LOG, _HIST) + """
, summed AS (SELECT model, le, sum(cumulative)::DOUBLE AS c FROM hist GROUP BY model, le),
steps AS (SELECT *, coalesce(lag(c) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lo,
    0.95::DOUBLE * max(c) OVER (PARTITION BY model) AS rnk
  FROM summed WINDOW w AS (PARTITION BY model ORDER BY le))
SELECT model, round(arg_min(CASE WHEN isinf(le) THEN lo WHEN c = below THEN le
  ELSE lo + (le - lo) * (rnk - below) / (c - below) END, le), 6) AS quantile
FROM steps WHERE c >= rnk GROUP BY model""",
    "batch_size_stats": sql.with_(sql.WORK_LOG, _SIZES) + """
SELECT month, count(*) AS n, round(avg(size), 6) AS mean_size,
  round(quantile_cont(size::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(size::DOUBLE, 0.95), 6) AS p95,
  max(size) AS max_size FROM sizes GROUP BY month""",
    "batch_size_distribution": sql.with_(sql.WORK_LOG, _SIZES) + """
SELECT month, size, count(*) AS n_batches FROM sizes GROUP BY month, size""",
    "load_imbalance": sql.with_(sql.REQUEST_LOG) + """
SELECT model, round(max(c) / (sum(c) / 8.0::DOUBLE), 6) AS max_over_mean,
  round(max(c)::DOUBLE, 6) AS max_over_min
FROM (SELECT model, prefix_id % 7 AS w, count(*) AS c FROM request_log GROUP BY 1, 2) GROUP BY model""",
    "work_load_imbalance": """
SELECT l_returnflag, round(max(c) / (sum(c) / (SELECT count(*) FROM supplier)), 6) AS max_over_mean,
  round(CASE WHEN count(*) < (SELECT count(*) FROM supplier) THEN max(c)
    ELSE max(c) / min(c) END, 6) AS max_over_min
FROM (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS c FROM lineitem GROUP BY 1, 2)
GROUP BY l_returnflag""",
    "utilisation": sql.with_(sql.REQUEST_LOG) + """
, per AS (SELECT model, worker_id, sum(inference_ms) AS b, min(ts_us) AS s,
    max(ts_us + total_ms * 1000) AS e FROM request_log GROUP BY 1, 2)
SELECT model, round(sum(b), 6) AS busy_ms, round((max(e) - min(s)) / 1000, 6) AS span_ms,
  round(sum(b) / (16 * ((max(e) - min(s)) / 1000)), 6) AS utilisation,
  round(max(b) / (sum(b) / 4), 6) AS busy_imbalance FROM per GROUP BY model""",
    "throughput": sql.with_(sql.WORK_LOG) + """
SELECT worker_id, count(*) AS n, round(count(*) / s, 12) AS per_second,
  round(sum(tokens) / s, 10) AS tokens_per_second
FROM work_log JOIN (SELECT worker_id, greatest((max(ts_us + busy_ms * 1000) - min(ts_us)) / 1e6, 1e-9)
    AS s FROM work_log GROUP BY worker_id) USING (worker_id) GROUP BY worker_id, s""",
    "queue_depth": sql.with_(clean_queries.DEPTH_EVENTS, _DEPTH) + """
SELECT model, priority, t_us, phase, seq, depth FROM depths""",
    "queue_depth_hourly": sql.with_(clean_queries.DEPTH_EVENTS, _DEPTH) + """
SELECT model, priority, t_us // 3600000000 * 3600000000 AS window_us,
  arg_max(depth, (t_us, phase, seq)) AS depth FROM depths GROUP BY 1, 2, 3""",
    "fleet_queue_depth": sql.with_(clean_queries.DEPTH_EVENTS, _DEPTH, _FLEET_HOURS)
    + "SELECT window_us, depth FROM hours",
    "inflight": sql.with_(sql.REQUEST_LOG, _INFLIGHT) + """
SELECT worker_id, seq, t_us, phase, depth FROM running""",
    "inflight_peak": sql.with_(sql.REQUEST_LOG, _INFLIGHT) + """
SELECT worker_id, max(depth) AS peak FROM running GROUP BY worker_id""",
    "topk_mass": sql.with_(sql.REQUEST_LOG) + """
, c AS (SELECT prefix_hash, count(*) AS c FROM request_log GROUP BY 1)
SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS distinct_prefixes,
  round((SELECT sum(c) FROM (SELECT c FROM c ORDER BY c DESC LIMIT 8))::DOUBLE / sum(c)::DOUBLE, 6)
    AS topk_mass FROM c""",
    "document_topk_mass": """
WITH c AS (SELECT substr(text, 1, 32) AS p, count(*) AS c FROM documents GROUP BY 1)
SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS distinct_prefixes,
  round((SELECT sum(c) FROM (SELECT c FROM c ORDER BY c DESC LIMIT 8))::DOUBLE / sum(c)::DOUBLE, 6)
    AS topk_mass FROM c""",
    "queue_wait_stats": sql.with_(sql.REQUEST_LOG) + _pct(
        "queue_wait_ms", "model", "request_log", ", round(avg(queue_wait_ms), 6) AS mean_wait"),
    "desired_workers": sql.with_(clean_queries.DEPTH_EVENTS, _DEPTH, _FLEET_HOURS) + """
, want AS (SELECT *, CAST(least(greatest(ceil(depth / 2.0::DOUBLE), 2), 20) AS INTEGER) AS desired
  FROM hours)
SELECT window_us, depth, desired,
  min(desired) OVER (ORDER BY window_us RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS scale_up_to,
  max(desired) OVER (ORDER BY window_us RANGE BETWEEN 28800000000 PRECEDING AND CURRENT ROW)
    AS scale_down_to FROM want""",
    "status_lifecycle": sql.with_(sql.JOB_EVENTS) + """
SELECT status, count(*) AS n, round(sum(nxt - ts_us)::DOUBLE / count(nxt - ts_us) / 1000, 3) AS mean_ms_in_status,
  round(count(*) / (SELECT count(*) FROM job_events)::DOUBLE, 6) AS share
FROM (SELECT *, lead(ts_us) OVER (PARTITION BY job_id ORDER BY ts_us, seq) AS nxt FROM job_events)
GROUP BY status""",
}
