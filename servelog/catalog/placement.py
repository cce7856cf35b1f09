"""Queries of 2D: placement of rows on workers, and the policy comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelog.catalog import sql, views
from servelog.catalog.common import r6
from servelog.operators import metrics, placement, sweep
from servelog.session import cut

INF = placement.UNBOUNDED
SWEEP = placement.CAP_SWEEP


def _day():
    return F.floor(F.col("ts_us") / views.DAY_US).cast("long")


def _log(spark, sf_dir):
    return views.request_log(spark, sf_dir).select("seq", "ts_us", "prefix_hash")


def bounded_load_assign(spark, sf_dir):
    return placement.bounded_load_assign(_log(spark, sf_dir), "prefix_hash",
                                         views.workers(spark), 1.25, _day())


def balanced_assign(spark, sf_dir):
    return placement.balanced_assign(_log(spark, sf_dir), views.workers(spark), _day())


def shared_stem_keys(spark, sf_dir):
    return placement.shared_stem_key(views.prompt_chains_once(spark, sf_dir),
                                     views.prompt_log(spark, sf_dir), min_support=3)


def stem_placement(spark, sf_dir):
    """Whole documents placed by their shared stem, 100 documents per window."""
    stems = cut(shared_stem_keys(spark, sf_dir))
    placed = placement.bounded_load_assign(stems, "stem_key", views.workers(spark), 1.5,
                                           F.floor(F.col("seq") / 100).cast("long"))
    return placed.select("win", "seq", "worker_id", "rank")


def _facts(spark, sf_dir):
    return views.request_log(spark, sf_dir).select(
        "seq", "ts_us", "prefix_hash", "queue_wait_ms", "total_ms",
        F.col("inference_ms").alias("busy_ms"), F.col("ts_us").alias("enqueue_us"),
        (F.col("ts_us") + F.col("total_ms") * 1000).alias("completed_us"))


_ROUNDED = ("hit_rate", "throughput_rps", "load_imbalance", "busy_imbalance",
            "mean_queue_wait_ms", "utilisation", "p50", "p95", "p99")


def _summary(spark, sf_dir, caps):
    got = sweep.cap_sweep(_facts(spark, sf_dir), "prefix_hash", views.workers(spark), _day(),
                          caps, slots=4, steady=F.col("seq") >= 100)
    return got.select("policy", "cap_factor", "n", *[r6(c) for c in _ROUNDED])


def policy_summary(spark, sf_dir):
    return _summary(spark, sf_dir, (1.5,))


def cap_sweep(spark, sf_dir):
    return _summary(spark, sf_dir, SWEEP)


def backpressure_rows(spark, sf_dir):
    return placement.backpressure_rows(_log(spark, sf_dir), "prefix_hash", views.workers(spark),
                                       0.6, _day())


def per_worker_pivot(spark, sf_dir):
    rows = sweep.policy_rows(_facts(spark, sf_dir), "prefix_hash", views.workers(spark), _day(), (1.5,))
    got = metrics.per_worker_pivot(rows, ["affinity", "balanced"])
    return got.select("worker_id", "affinity_items", r6("affinity_hit_rate"), "balanced_items",
                      r6("balanced_hit_rate"))


def eligible_placement(spark, sf_dir):
    """Column-valued eligibility and base load instead of callables."""
    fleet = spark.createDataFrame([("w0", 1, 0), ("w1", 1, 40), ("w2", 0, 0), ("w3", 2, 10)],
                                  "worker_id string, free_slots int, queued int")
    return placement.bounded_load_assign(
        _log(spark, sf_dir), "prefix_hash", fleet, 1.25, _day(),
        eligible=F.col("free_slots") > 0, load=F.col("queued"))


def capable_placement(spark, sf_dir):
    """A row only goes to workers that hold its model: m2 to one of four."""
    log = views.request_log(spark, sf_dir).select("seq", "ts_us", "prefix_hash", "model")
    placed = placement.place(log, "prefix_hash", views.workers(spark), [1.25], _day(), model="model")
    return placed.select("win", "seq", "worker_id", "rank")


QUERIES = {f.__name__: f for f in (
    bounded_load_assign, balanced_assign, shared_stem_keys, stem_placement, policy_summary,
    cap_sweep, backpressure_rows, per_worker_pivot, eligible_placement,
    capable_placement)}

_ROWS = "SELECT ts_us // 86400000000 AS win, seq, prefix_hash AS key FROM request_log"
_KEYS = "SELECT prefix_hash AS key FROM request_log"


def _base(caps):
    return (sql.REQUEST_LOG, sql.WORKERS, sql.ring(), sql.preferences(_KEYS),
            sql.placement(_ROWS, caps))


_BALANCED = """
dealt AS (SELECT ts_us // 86400000000 AS win, seq, 'w' || ((row_number() OVER (
    PARTITION BY ts_us // 86400000000 ORDER BY seq) - 1) % 4) AS worker_id FROM request_log)"""

_POLICIES = _BALANCED + """,
chosen AS (
  SELECT 'balanced' AS policy, 0.0::DOUBLE AS cap_factor, seq, worker_id FROM dealt
  UNION ALL SELECT 'affinity', cap_factor, seq, worker_id FROM placed),
policy_rows AS (
  SELECT c.policy, c.cap_factor, c.worker_id, r.* EXCLUDE (worker_id),
    r.seq > min(r.seq) OVER (PARTITION BY c.policy, c.cap_factor, c.worker_id, r.prefix_hash) AS hit
  FROM chosen c JOIN request_log r ON r.seq = c.seq)"""

_SUMMARY = _POLICIES + """,
steady AS (SELECT *, ts_us + total_ms * 1000 AS completed_us FROM policy_rows WHERE seq >= 100),
span AS (SELECT policy, cap_factor, (max(completed_us) - min(ts_us)) / 1e6 AS s
  FROM steady GROUP BY policy, cap_factor),
per AS (SELECT policy, cap_factor, worker_id, count(*) AS c, sum(inference_ms) AS b
  FROM steady GROUP BY policy, cap_factor, worker_id),
wide AS (SELECT policy, cap_factor, max(c) / (sum(c) / 4.0::DOUBLE) AS load_imbalance,
  max(b) / (sum(b) / 4) AS busy_imbalance FROM per GROUP BY policy, cap_factor)
SELECT t.policy, t.cap_factor, count(*) AS n, round(avg(CAST(hit AS INTEGER)), 6) AS hit_rate,
  round(count(*) / any_value(s), 6) AS throughput_rps,
  round(any_value(load_imbalance), 6) AS load_imbalance,
  round(any_value(busy_imbalance), 6) AS busy_imbalance,
  round(avg(queue_wait_ms), 6) AS mean_queue_wait_ms,
  round(sum(inference_ms) / (4 * 4 * any_value(s) * 1000), 6) AS utilisation,
  round(quantile_cont(total_ms, 0.5), 6) AS p50, round(quantile_cont(total_ms, 0.95), 6) AS p95,
  round(quantile_cont(total_ms, 0.99), 6) AS p99
FROM steady t JOIN span USING (policy, cap_factor) JOIN wide USING (policy, cap_factor)
GROUP BY t.policy, t.cap_factor"""

def _capable(model, ids):
    listed = ", ".join(f"('{w}')" for w in ids)
    rows = f"{_ROWS} WHERE model = '{model}'"
    return "SELECT win, seq, worker_id, rank FROM (" + sql.with_(
        sql.REQUEST_LOG, f"fleet AS (SELECT * FROM (VALUES {listed}) AS f(worker_id))", sql.ring("fleet"),
        sql.preferences(_KEYS), sql.placement(rows, ("1.25",), (0,) * len(ids), ids)) + "SELECT * FROM placed)"


_STEMS = """
, support AS (SELECT chain_hash, count(*) AS s FROM chains GROUP BY chain_hash),
named AS (SELECT seq, coalesce(arg_max(c.chain_hash, depth) FILTER (s >= 3),
    min(c.chain_hash) FILTER (depth = 1)) AS stem_key, coalesce(max(depth) FILTER (s >= 3), 1) AS stem_depth
  FROM chains c JOIN support u ON u.chain_hash = c.chain_hash GROUP BY seq),
stems AS (SELECT doc_id AS seq, coalesce(stem_key, md5(coalesce(text, ''))) AS stem_key,
    coalesce(stem_depth, 0) AS stem_depth FROM documents LEFT JOIN named ON seq = doc_id)
"""

SQL = {
    "bounded_load_assign": sql.with_(*_base(("1.25",))) + """
SELECT win, seq, worker_id, rank FROM placed WHERE worker_id IS NOT NULL""",
    "balanced_assign": sql.with_(sql.REQUEST_LOG, _BALANCED) + "SELECT * FROM dealt",
    "shared_stem_keys": sql.with_(sql.CHAINS, recursive=True) + _STEMS + "SELECT * FROM stems",
    "stem_placement": sql.with_(sql.CHAINS, recursive=True) + _STEMS + ","
    + ",".join((sql.WORKERS, sql.ring(), sql.preferences("SELECT stem_key AS key FROM stems"),
                sql.placement("SELECT seq // 100 AS win, seq, stem_key AS key FROM stems", ("1.5",)))) + """
SELECT win, seq, worker_id, rank FROM placed WHERE worker_id IS NOT NULL""",
    "policy_summary": sql.with_(*_base(("1.5",)), _SUMMARY),
    "cap_sweep": sql.with_(*_base(tuple("Infinity" if c == INF else str(c) for c in SWEEP)), _SUMMARY),
    "eligible_placement": sql.with_(
        sql.REQUEST_LOG, "fleet AS (SELECT * FROM (VALUES ('w0'), ('w1'), ('w3')) AS f(worker_id))",
        sql.ring("fleet"), sql.preferences(_KEYS),
        sql.placement(_ROWS, ("1.25",), (0, 40, 10), ("w0", "w1", "w3"))) + """
SELECT win, seq, worker_id, rank FROM placed WHERE worker_id IS NOT NULL""",
    "capable_placement": " UNION ALL ".join((
        _capable("m0", ("w0", "w2", "w3")), _capable("m1", ("w0", "w1", "w3")), _capable("m2", ("w1",)))),
    "backpressure_rows": sql.with_(*_base(("0.6",))) + """
SELECT win, seq FROM placed WHERE worker_id IS NULL""",
    "per_worker_pivot": sql.with_(*_base(("1.5",)), _POLICIES) + """
SELECT worker_id, count(*) FILTER (policy = 'affinity') AS affinity_items,
  round(avg(CAST(hit AS INTEGER)) FILTER (policy = 'affinity'), 6) AS affinity_hit_rate,
  count(*) FILTER (policy = 'balanced') AS balanced_items,
  round(avg(CAST(hit AS INTEGER)) FILTER (policy = 'balanced'), 6) AS balanced_hit_rate
FROM policy_rows GROUP BY worker_id""",
}
