"""Queries of 2G: fits, calibration, confidence intervals, crossover."""

from __future__ import annotations

from pyspark.sql import functions as F

from servelog.catalog import sql, views
from servelog.catalog.common import r6
from servelog.operators import stats


def linear_fit(spark, sf_dir):
    got = stats.linear_fit(views.request_log(spark, sf_dir), "prompt_tokens", "inference_ms", ["model"])
    return got.select("model", "n", *[r6(c) for c in ("slope", "intercept", "r2")])


def rate_calibration(spark, sf_dir):
    rows = views.request_log(spark, sf_dir).select(
        "model", "prompt_tokens", (F.col("prompt_tokens") * 0.5).alias("prefill_ms"),
        F.col("prefix_id").alias("out_tokens"), F.col("inference_ms").alias("decode_ms"),
        (F.col("total_ms") * 2).alias("total_ms"))
    got = stats.rate_calibration(rows, ["model"])
    return got.select("model", "n", *[r6(c) for c in (
        "decode_ms_per_token", "prefill_ms_per_token", "alpha_ms", "beta_ms", "prefill_ms")])


def mean_ci(spark, sf_dir):
    got = stats.mean_ci(views.sweep(spark, sf_dir), "p99", ["length", "policy"])
    return got.select("length", "policy", "n", r6("mean"), r6("ci"))


def best_policy(spark, sf_dir):
    got = stats.best_policy(views.sweep(spark, sf_dir), ["length", "seed"])
    return got.select("length", "seed", F.round("p99", 9).alias("p99"), "cap", "policy")


def _speedups(spark, sf_dir):
    return stats.speedup(views.sweep(spark, sf_dir), "R", ["length", "seed"])


def speedup(spark, sf_dir):
    return _speedups(spark, sf_dir).select(
        "length", "seed", *[F.round(c, 9).alias(c) for c in ("base_p99", "best_p99", "speedup")])


def crossover(spark, sf_dir):
    got = stats.crossover(_speedups(spark, sf_dir), "length", "speedup")
    return got.select("seed", r6("crossing"))


def crossover_summary(spark, sf_dir):
    speedups = _speedups(spark, sf_dir)
    got = stats.crossover_summary(stats.crossover(speedups, "length", "speedup"), speedups)
    return got.select("n_crossed", "n_seeds", r6("mean"), r6("ci"))


QUERIES = {f.__name__: f for f in (linear_fit, rate_calibration, mean_ci, best_policy, speedup,
                                   crossover, crossover_summary)}

_T = "[" + ", ".join(f"{t}::DOUBLE" for t in stats.T95) + "]"
_CI = f"""CASE WHEN n = 1 THEN 0.0::DOUBLE WHEN n > 1 THEN
  (CASE WHEN n <= 31 THEN ({_T})[n - 1] ELSE 1.96::DOUBLE END) * sd / sqrt(n) END"""

_SPEEDUP = """
speedups AS (SELECT *, CASE WHEN best_p99 <> 0 THEN base_p99 / best_p99 END AS speedup FROM (
  SELECT length, seed, min(p99) FILTER (policy = 'R') AS base_p99,
    min(p99) FILTER (policy <> 'R') AS best_p99 FROM sweep GROUP BY length, seed))"""

_CROSS = """
pairs AS (SELECT seed, length::DOUBLE AS x0, speedup AS y0,
    lead(length) OVER w AS x1, lead(speedup) OVER w AS y1
  FROM speedups WINDOW w AS (PARTITION BY seed ORDER BY length)),
spots AS (SELECT seed, x0, CASE WHEN y0 = 1 THEN x0 WHEN (y0 - 1) * (y1 - 1) < 0
    THEN x0 + (1 - y0) / (y1 - y0) * (x1 - x0) END AS spot FROM pairs WHERE x1 IS NOT NULL),
crossings AS (SELECT seed, arg_min(spot, x0) AS crossing FROM spots WHERE spot IS NOT NULL GROUP BY seed)"""

SQL = {
    "linear_fit": sql.with_(sql.REQUEST_LOG) + """
SELECT model, count(*) AS n, round(regr_slope(inference_ms, prompt_tokens), 6) AS slope,
  round(regr_intercept(inference_ms, prompt_tokens), 6) AS intercept,
  round(regr_r2(inference_ms, prompt_tokens), 6) AS r2 FROM request_log GROUP BY model""",
    "rate_calibration": sql.with_(sql.REQUEST_LOG) + """
, fitted AS (SELECT model, count(*) AS n,
    greatest(0, regr_slope(inference_ms, prefix_id)) AS decode_ms_per_token,
    greatest(0, regr_intercept(inference_ms, prefix_id)) AS i,
    avg(prompt_tokens * 0.5::DOUBLE / prompt_tokens) AS prefill_ms_per_token,
    avg(prompt_tokens) AS tokens,
    avg(greatest(0, total_ms * 2 - prompt_tokens * 0.5::DOUBLE - inference_ms)) AS overhead
  FROM request_log WHERE prompt_tokens > 0 AND prefix_id > 0 GROUP BY model)
SELECT model, n, round(decode_ms_per_token, 6) AS decode_ms_per_token,
  round(prefill_ms_per_token, 6) AS prefill_ms_per_token, round(overhead + i, 6) AS alpha_ms,
  round(decode_ms_per_token * 64, 6) AS beta_ms, round(prefill_ms_per_token * tokens, 6) AS prefill_ms
FROM fitted""",
    "mean_ci": sql.with_(sql.SWEEP) + f"""
SELECT length, policy, n, round(mean, 6) AS mean, round({_CI}, 6) AS ci
FROM (SELECT length, policy, count(p99) AS n, avg(p99) AS mean, stddev_samp(p99) AS sd
      FROM sweep GROUP BY length, policy)""",
    "best_policy": sql.with_(sql.SWEEP) + """
SELECT length, seed, round(p99, 9) AS p99, cap, policy FROM sweep
QUALIFY row_number() OVER (PARTITION BY length, seed ORDER BY p99, cap, policy) = 1""",
    "speedup": sql.with_(sql.SWEEP, _SPEEDUP) + """
SELECT length, seed, round(base_p99, 9) AS base_p99, round(best_p99, 9) AS best_p99,
  round(speedup, 9) AS speedup FROM speedups""",
    "crossover": sql.with_(sql.SWEEP, _SPEEDUP, _CROSS) + """
SELECT seed, round(crossing, 6) AS crossing FROM crossings""",
    "crossover_summary": sql.with_(sql.SWEEP, _SPEEDUP, _CROSS) + f"""
SELECT n AS n_crossed, n_seeds, round(mean, 6) AS mean, round({_CI}, 6) AS ci
FROM (SELECT count(crossing) AS n, avg(crossing) AS mean, stddev_samp(crossing) AS sd,
        (SELECT count(DISTINCT seed) FROM speedups) AS n_seeds FROM crossings)""",
}
