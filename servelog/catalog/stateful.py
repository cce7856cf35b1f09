"""Queries of 2H: stateful operators, batch twins and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelog.catalog import sql, views
from servelog.catalog.common import r6
from servelog.operators import stateful
from servelog.streaming import metrics as stream_metrics
from servelog.streaming import stateful as streams
from servelog.streaming.run import arrival_slices, replay

RPS, BURST = 1 / 14400, 3.0
DAY_US = views.DAY_US
BUDGETS_MS = {"high": 600_000.0, "default": 3_000_000.0}  # 10 and 50 minutes
TTL_US = 12 * 3_600_000_000
JOB_TTL_US = 20 * DAY_US
STREAM_JOB_TTL_US = 5 * DAY_US
NOW_US = 1_706_745_600_000_000  # 2024-02-01, just after the log


def _bucket_rows(spark, sf_dir):
    return views.request_log(spark, sf_dir).select("api_key", "seq", "ts_us")


def token_bucket(spark, sf_dir):
    got = stateful.token_bucket(_bucket_rows(spark, sf_dir), "api_key", RPS, BURST)
    return got.select("api_key", "seq", "allowed", r6("tokens"), r6("retry_after_s"))


def token_bucket_hot_key(spark, sf_dir):
    """The whole log as one key, folded in slices."""
    rows = _bucket_rows(spark, sf_dir).withColumn("api_key", F.lit(0).cast("long"))
    got = stateful.token_bucket(rows, "api_key", 1 / 300, 5.0, fold_rows=1000)
    return got.select("seq", "allowed", r6("tokens"), r6("retry_after_s"))


def idempotent(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("idem_key", "seq", "ts_us", "request_id")
    return stateful.idempotent(rows, "idem_key", DAY_US).select(
        "idem_key", "seq", "original_id", "duplicate")


def idempotent_hot_key(spark, sf_dir):
    """A third of the log shares one key and takes the windowed path."""
    rows = views.request_log(spark, sf_dir).select(
        F.when(F.col("seq") % 3 == 0, "hot").otherwise(F.col("idem_key")).alias("idem_key"),
        "seq", "ts_us", "request_id")
    return stateful.idempotent(rows, "idem_key", 5 * DAY_US, fold_rows=1000).select(
        "idem_key", "seq", "original_id", "duplicate")


def _batch_rows(spark, sf_dir):
    return views.request_log(spark, sf_dir).select("model", "seq", "ts_us", "priority")


def size_or_deadline_batches(spark, sf_dir):
    got = stateful.size_or_deadline_batches(_batch_rows(spark, sf_dir), "model", 8, BUDGETS_MS,
                                            fold_rows=1000)
    return got.select("model", "seq", "batch_no", "trigger", "closed_us", "slot")


def _beats(spark, sf_dir):
    return views.request_log(spark, sf_dir).select(
        F.concat(F.lit("w"), F.col("api_key").cast("string")).alias("worker_id"), "ts", "ts_us")


def worker_liveness(spark, sf_dir):
    return stateful.worker_liveness(_beats(spark, sf_dir), TTL_US)


def active_workers(spark, sf_dir):
    lives = stateful.worker_liveness(_beats(spark, sf_dir), TTL_US)
    return stateful.active_workers(lives, 1_705_320_000_000_000)


def job_state(spark, sf_dir):
    return stateful.job_state(views.job_events(spark, sf_dir), F.lit(NOW_US), JOB_TTL_US)


def assemble_tokens(spark, sf_dir):
    return stateful.assemble_tokens(views.token_log(spark, sf_dir), slice_rows=3)


# --- streams: the same rows, arriving in slices --------------------------------

def _by_seq(rows):
    return arrival_slices(rows, "seq", 2)


def stream_token_bucket(spark, sf_dir):
    rows = _bucket_rows(spark, sf_dir)
    got = replay([rows], _by_seq(rows),
                 lambda s: streams.stream_token_bucket(s, "api_key", RPS, BURST), "bucket")
    return got.select("api_key", "seq", "allowed", r6("tokens"), r6("retry_after_s"))


def stream_idempotent(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("idem_key", "seq", "ts", "ts_us", "request_id")
    return replay([rows], _by_seq(rows),
                  lambda s: streams.stream_idempotent(s, "idem_key", DAY_US), "idem")


def stream_batches(spark, sf_dir):
    """Batches closed by the time the log ends; a pending one waits for its timer."""
    rows = views.request_log(spark, sf_dir).select("model", "seq", "ts", "ts_us", "priority")
    return replay([rows], _by_seq(rows),
                  lambda s: streams.stream_batches(s, "model", 8, BUDGETS_MS), "batches")


def stream_job_state(spark, sf_dir):
    """Jobs that live 5 days in a log of 30: they expire and are created anew."""
    rows = views.job_events(spark, sf_dir)
    got = replay([rows], _by_seq(rows), lambda s: streams.stream_job_state(s, STREAM_JOB_TTL_US),
                 "jobs", "update")
    last = F.max(F.struct("updated_us", "created_us", "status")).alias("j")
    return got.groupBy("job_id").agg(last).select("job_id", "j.*")


def stream_tokens(spark, sf_dir):
    """Tokens that arrive in any order, final rows early and late; a closing mark a day later
    moves the watermark past all of them."""
    rows = views.token_log(spark, sf_dir).select(
        "job_id", "seq", (NOW_US + F.col("seq") * 1_000_000).alias("ts_us"), "token", "final",
        F.pmod(F.xxhash64("job_id", "seq"), F.lit(3)).alias("arrival"))
    mark = spark.range(1).select(F.lit(-1).cast("long").alias("job_id"), F.lit(0).cast("long").alias("seq"),
                                 F.lit(NOW_US + DAY_US).alias("ts_us"), F.lit("").alias("token"),
                                 F.lit(False).alias("final"), F.lit(2).cast("long").alias("arrival"))
    rows = rows.unionByName(mark).withColumn("ts", F.timestamp_micros("ts_us"))
    return replay([rows], [F.col("arrival") == k for k in range(3)],
                  lambda s: streams.stream_tokens(s, delay="1 hour"), "tokens")


def streaming_metrics(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("seq", "ts", "status", "queue_wait_ms", "total_ms")
    got = replay([rows], _by_seq(rows),
                 lambda s: stream_metrics.streaming_metrics(s, "0 seconds", "1 day"), "metrics")
    return got.select(F.unix_micros("window_start").alias("window_us"), "status", "n", r6("rate"),
                      r6("mean_queue_wait_ms"), r6("max_queue_wait_ms"), r6("mean_total_ms"))


def streaming_quantiles(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select("seq", "ts", "model", (F.col("total_ms") / 100).alias("v"))
    got = replay([rows], _by_seq(rows), lambda s: stream_metrics.streaming_quantiles(
        s, "0 seconds", "v", "1 day", by=["model"]), "quantiles")
    return got.select(F.unix_micros("window_start").alias("window_us"), "model", "n",
                      *[r6(p) for p in ("p50", "p95", "p99")])


def streaming_liveness(spark, sf_dir):
    rows = _beats(spark, sf_dir).withColumn("seq", F.floor(F.col("ts_us") / 3_600_000_000))
    got = replay([rows], _by_seq(rows),
                 lambda s: stream_metrics.streaming_sessions(s, "12 hours", "0 seconds"), "lives")
    return got.select("worker_id", "up_from_us", "up_until_us", "beats")


def stream_unacked(spark, sf_dir):
    rows = views.request_log(spark, sf_dir)
    sent = rows.select("request_id", "seq", F.col("ts").alias("delivered_at"))
    late = F.col("ts") + F.make_dt_interval(mins=F.col("prefix_id"))
    acks = rows.where("prefix_id % 2 = 0").select("request_id", "seq", late.alias("acked_at"))
    got = replay([sent, acks], _by_seq(sent),
                 lambda d, a: streams.stream_unacked(d, a, "30 minutes"), "unacked")
    return got.select("request_id", "seq")


QUERIES = {f.__name__: f for f in (
    token_bucket, token_bucket_hot_key, idempotent, idempotent_hot_key, size_or_deadline_batches,
    worker_liveness, active_workers, job_state, assemble_tokens, stream_token_bucket,
    stream_idempotent, stream_batches, stream_job_state, stream_tokens, streaming_metrics,
    streaming_quantiles, streaming_liveness, stream_unacked)}


def _bucket_sql(key, den, burst, columns):
    unit = 1_000_000 * den
    top = int(burst * unit)
    return f"""
WITH RECURSIVE calls AS (SELECT {key} AS api_key, event_id AS seq, epoch_us(ts) AS ts_us,
    row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS pos FROM events),
folded AS (
  SELECT api_key, seq, ts_us, pos, {top} >= {unit} AS allowed,
    CASE WHEN {top} >= {unit} THEN {top} - {unit} ELSE {top} END::BIGINT AS tok
  FROM calls WHERE pos = 1
  UNION ALL
  SELECT api_key, seq, ts_us, pos, t >= {unit}, CASE WHEN t >= {unit} THEN t - {unit} ELSE t END
  FROM (SELECT c.api_key, c.seq, c.ts_us, c.pos,
          least({top}, f.tok + greatest(0, c.ts_us - f.ts_us))::BIGINT AS t
        FROM folded f JOIN calls c ON c.api_key = f.api_key AND c.pos = f.pos + 1))
SELECT {columns}seq, allowed, round(tok / {unit}.0::DOUBLE, 6) AS tokens,
  CASE WHEN allowed THEN 0.0::DOUBLE ELSE round(({unit} - tok) / 1000000.0::DOUBLE, 6) END
    AS retry_after_s
FROM folded"""


def _idem_sql(key, ttl):
    return f"""
WITH RECURSIVE calls AS (SELECT {key} AS idem_key, event_id AS seq, epoch_us(ts) AS ts_us,
    printf('req-%08d', event_id) AS rid,
    row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS pos
  FROM (SELECT *, user_id || ':' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS ik
        FROM events)),
folded AS (
  SELECT idem_key, seq, pos, rid AS original_id, false AS duplicate, ts_us AS opened
  FROM calls WHERE pos = 1
  UNION ALL
  SELECT c.idem_key, c.seq, c.pos, CASE WHEN c.ts_us < f.opened + {ttl} THEN f.original_id ELSE c.rid END,
    c.ts_us < f.opened + {ttl}, CASE WHEN c.ts_us < f.opened + {ttl} THEN f.opened ELSE c.ts_us END
  FROM folded f JOIN calls c ON c.idem_key = f.idem_key AND c.pos = f.pos + 1)
SELECT idem_key, seq, original_id, duplicate FROM folded"""


_BATCH_FOLD = f"""
WITH RECURSIVE calls AS (SELECT 'm' || (user_id % 3) AS model, event_id AS seq,
    epoch_us(ts) AS ts_us, CASE WHEN user_id % 10 = 0 THEN 'high' ELSE 'default' END AS priority,
    epoch_us(ts) + CASE WHEN user_id % 10 = 0 THEN {600_000_000} ELSE {3_000_000_000} END AS due,
    row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS pos FROM events),
folded AS (
  SELECT model, seq, ts_us, priority, pos, pos AS batch_no, seq AS first_seq, 1 AS c, due AS d
  FROM calls WHERE pos = 1
  UNION ALL
  SELECT model, seq, ts_us, priority, pos, CASE WHEN new THEN pos ELSE batch_no END,
    CASE WHEN new THEN seq ELSE first_seq END, CASE WHEN new THEN 1 ELSE c + 1 END,
    CASE WHEN new THEN due ELSE least(d, due) END
  FROM (SELECT c.*, f.batch_no, f.first_seq, f.c, f.d, f.c = 8 OR c.ts_us >= f.d AS new
        FROM folded f JOIN calls c ON c.model = f.model AND c.pos = f.pos + 1)),
closed AS (SELECT *, max(c) OVER b = 8 AS is_full, max(ts_us) OVER b AS last_ts, min(d) OVER b AS due,
    max(pos) OVER (PARTITION BY model) AS model_end, max(pos) OVER b AS batch_end,
    row_number() OVER (PARTITION BY model, batch_no ORDER BY priority DESC, ts_us, seq) AS slot
  FROM folded WINDOW b AS (PARTITION BY model, batch_no)),
answer AS (SELECT model, seq, batch_no, first_seq, CASE WHEN is_full THEN 'full' ELSE 'overdue' END
    AS trigger, CASE WHEN is_full THEN last_ts ELSE due END AS closed_us, slot,
    is_full OR batch_end < model_end AS over FROM closed)
"""

_LIVES = sql.REQUEST_LOG + f""",
beats AS (SELECT 'w' || api_key AS worker_id, ts_us,
    lag(ts_us) OVER (PARTITION BY api_key ORDER BY ts_us) AS prev FROM request_log),
islands AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts_us - prev >= {TTL_US} THEN 1 ELSE 0 END)
    OVER (PARTITION BY worker_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS life FROM beats),
lives AS (SELECT worker_id, min(ts_us) AS up_from_us, max(ts_us) + {TTL_US} AS up_until_us,
    count(*) AS beats FROM islands GROUP BY worker_id, life)"""

def _jobs_sql(ttl):
    return f"""
WITH RECURSIVE calls AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_us, seq) AS pos FROM (
    SELECT user_id || ':' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS job_id, event_id AS seq,
      epoch_us(ts) AS ts_us, event_type AS status FROM events)),
folded AS (
  SELECT job_id, ts_us, status, pos, ts_us AS created_us FROM calls WHERE pos = 1
  UNION ALL
  SELECT c.job_id, c.ts_us, c.status, c.pos, CASE WHEN c.ts_us < f.created_us + {ttl} THEN f.created_us ELSE c.ts_us END
  FROM folded f JOIN calls c ON c.job_id = f.job_id AND c.pos = f.pos + 1),
states AS (SELECT job_id, arg_max(created_us, pos) AS created_us, max(ts_us) AS updated_us,
    arg_max(status, pos) AS status FROM folded GROUP BY job_id)
"""


SQL = {
    "token_bucket": _bucket_sql("user_id", 14400, BURST, "api_key, "),
    "token_bucket_hot_key": _bucket_sql("0", 300, 5.0, ""),
    "stream_token_bucket": _bucket_sql("user_id", 14400, BURST, "api_key, "),
    "idempotent": _idem_sql("ik", DAY_US),
    "idempotent_hot_key": _idem_sql("CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE ik END", 5 * DAY_US),
    "stream_idempotent": _idem_sql("ik", DAY_US),
    "size_or_deadline_batches": _BATCH_FOLD + """
SELECT model, seq, batch_no, trigger, closed_us, slot FROM answer""",
    "worker_liveness": sql.with_(_LIVES) + "SELECT * FROM lives",
    "active_workers": sql.with_(_LIVES) + """
SELECT worker_id FROM lives WHERE up_from_us <= 1705320000000000 AND up_until_us > 1705320000000000""",
    "job_state": _jobs_sql(JOB_TTL_US) + f"""
SELECT * FROM states WHERE {NOW_US} - created_us < {JOB_TTL_US}""",
    "stream_job_state": _jobs_sql(STREAM_JOB_TTL_US) + "SELECT * FROM states",
    "assemble_tokens": sql.with_(sql.TOKEN_LOG) + """
SELECT job_id, coalesce(string_agg(token, '' ORDER BY seq) FILTER (NOT final), '') AS text,
  count(*) FILTER (NOT final) AS n_tokens, true AS complete FROM token_log GROUP BY job_id""",
    "stream_tokens": sql.with_(sql.TOKEN_LOG) + """
SELECT job_id, coalesce(string_agg(token, '' ORDER BY seq) FILTER (NOT final), '') AS text,
  count(*) FILTER (NOT final) AS n_tokens FROM token_log GROUP BY job_id""",
    "stream_batches": _BATCH_FOLD + """
SELECT model, seq, first_seq, trigger, closed_us, slot FROM answer
WHERE over OR closed_us <= (SELECT max(epoch_us(ts)) FROM events)""",
    "streaming_metrics": sql.with_(sql.REQUEST_LOG) + """
SELECT ts_us // 86400000000 * 86400000000 AS window_us, status, count(*) AS n,
  round(count(*) / 86400.0::DOUBLE, 6) AS rate, round(avg(queue_wait_ms), 6) AS mean_queue_wait_ms,
  round(max(queue_wait_ms), 6) AS max_queue_wait_ms, round(avg(total_ms), 6) AS mean_total_ms
FROM request_log WHERE (ts_us // 86400000000 + 1) * 86400000000
  <= (SELECT max(epoch_us(ts)) FROM events) GROUP BY 1, 2""",
    "streaming_quantiles": sql.with_(sql.REQUEST_LOG) + """
, les AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0,
  7.5, 10.0, 'Infinity'::DOUBLE]::DOUBLE[]) AS le),
hist AS (SELECT ts_us // 86400000000 * 86400000000 AS window_us, model, le,
    count(*) FILTER (total_ms / 100 <= le) AS c, count(*) AS n
  FROM request_log, les WHERE (ts_us // 86400000000 + 1) * 86400000000 <= (SELECT max(epoch_us(ts)) FROM events)
  GROUP BY 1, 2, 3),
steps AS (SELECT *, coalesce(lag(c) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lo
  FROM hist WINDOW w AS (PARTITION BY window_us, model ORDER BY le)),
asked AS (SELECT steps.*, q, q * n AS rnk FROM steps, (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q)),
found AS (SELECT window_us, model, n, q, round(arg_min(CASE WHEN isinf(le) THEN lo WHEN c = below THEN le
    ELSE lo + (le - lo) * (rnk - below) / (c - below) END, le), 6) AS v
  FROM asked WHERE c >= rnk GROUP BY ALL)
SELECT window_us, model, n, max(v) FILTER (q = 0.5) AS p50, max(v) FILTER (q = 0.95) AS p95,
  max(v) FILTER (q = 0.99) AS p99 FROM found GROUP BY ALL""",
    "streaming_liveness": sql.with_(_LIVES) + """
SELECT * FROM lives WHERE up_until_us <= (SELECT max(epoch_us(ts)) FROM events)""",
    "stream_unacked": sql.with_(sql.REQUEST_LOG) + """
SELECT request_id, seq FROM request_log
WHERE NOT (prefix_id % 2 = 0 AND prefix_id < 30)
  AND ts_us + 1800000000 <= (SELECT least(max(ts_us),
    max(ts_us + prefix_id::BIGINT * 60000000) FILTER (prefix_id % 2 = 0)) FROM request_log)""",
}
