"""Statistics over measurements and sweep results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-sided 95% Student t for 1..30 degrees of freedom, then normal.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
       2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
       2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
Z95 = 1.96
NOMINAL_OUTPUT_TOKENS = 64  # Fixed value: tokens one request decodes.


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, n, slope, intercept, r2). A constant y fits perfectly: r2 = 1."""
    r2 = F.when(F.var_pop(y) == 0, F.lit(1.0)).otherwise(F.regr_r2(y, x))
    return df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
                               F.regr_intercept(y, x).alias("intercept"), r2.alias("r2"))


def rate_calibration(df: DataFrame, by: Sequence[str] = (),
                     nominal_tokens: int = NOMINAL_OUTPUT_TOKENS) -> DataFrame:
    """Decode and prefill rates and the derived alpha, beta, prefill constants.

    Rows without prompt or output tokens are degenerate and dropped.
    """
    rows = df.where((F.col("prompt_tokens") > 0) & (F.col("out_tokens") > 0))
    overhead = F.greatest(F.lit(0.0), F.col("total_ms") - F.col("prefill_ms") - F.col("decode_ms"))
    fitted = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.lit(0.0), F.regr_slope("decode_ms", "out_tokens")).alias("decode_ms_per_token"),
        F.regr_intercept("decode_ms", "out_tokens").alias("__i"),
        F.avg(F.col("prefill_ms") / F.col("prompt_tokens")).alias("prefill_ms_per_token"),
        F.avg("prompt_tokens").alias("__tokens"), F.avg(overhead).alias("__overhead"))
    return fitted.select(
        *by, "n", "decode_ms_per_token", "prefill_ms_per_token",
        (F.col("__overhead") + F.greatest(F.lit(0.0), F.col("__i"))).alias("alpha_ms"),
        (F.col("decode_ms_per_token") * nominal_tokens).alias("beta_ms"),
        (F.col("prefill_ms_per_token") * F.col("__tokens")).alias("prefill_ms"))


def _t95(dof: Column) -> Column:
    table = F.array(*[F.lit(t) for t in T95])
    within = F.least(F.greatest(dof, F.lit(1)), F.lit(len(T95))).cast("int")
    return F.when(dof <= len(T95), F.element_at(table, within)).otherwise(F.lit(Z95))


def mean_ci(df: DataFrame, value: str, by: Sequence[str] = (),
            rows: str | None = None) -> DataFrame:
    """(by…, n, mean, ci): 95% half-width, 0 for one sample, NULL for none.

    ``rows`` names an extra column counting all rows, finite or not.
    """
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    got = df.groupBy(*by).agg(F.count(finite).alias("n"), F.avg(finite).alias("mean"),
                              F.stddev_samp(finite).alias("__sd"),
                              F.count(F.lit(1)).alias(rows or "__rows"))
    half = _t95(F.col("n") - 1) * F.col("__sd") / F.sqrt("n")
    extra = [rows] if rows else []
    return got.select(*by, "n", *extra, "mean", F.when(F.col("n") == 1, F.lit(0.0))
                      .when(F.col("n") > 1, half).alias("ci"))


def best_policy(df: DataFrame, by: Sequence[str], p99: str = "p99", cap: str = "cap",
                carry: Sequence[str] = ("policy",)) -> DataFrame:
    """Row with the smallest p99 per group; the smaller cap wins a tie."""
    best = F.min(F.struct(p99, cap, *carry)).alias("b")
    return df.groupBy(*by).agg(best).select(*by, "b.*")


def speedup(df: DataFrame, baseline: str, by: Sequence[str], p99: str = "p99",
            cap: str = "cap", policy: str = "policy") -> DataFrame:
    """(by…, base_p99, best_p99, speedup) in one aggregation; NULL when the
    denominator is 0 or a side is missing."""
    is_base = F.col(policy) == baseline
    got = df.groupBy(*by).agg(F.min(F.when(is_base, F.col(p99))).alias("base_p99"),
                              F.min(F.when(~is_base, F.col(p99))).alias("best_p99"))
    ratio = F.when(F.col("best_p99") != 0, F.col("base_p99") / F.col("best_p99"))
    return got.withColumn("speedup", ratio)


def crossover(df: DataFrame, x: str, y: str, by: Sequence[str] = ("seed",),
              level: float = 1.0) -> DataFrame:
    """(by…, crossing): first x where y crosses ``level``; no crossing, no row.

    A grid point exactly on the level counts when it starts an interval, a sign
    change is interpolated. The window spans one sweep's grid of x values.
    """
    order = Window.partitionBy(*by).orderBy(x)
    x1, y1 = F.lead(x).over(order), F.lead(y).over(order)
    steps = df.select(*by, F.col(x).cast("double").alias("x0"), F.col(y).alias("y0"),
                      x1.cast("double").alias("x1"), y1.alias("y1")).where("x1 is not null")
    a, b = F.col("y0") - level, F.col("y1") - level
    at = (F.when(a == 0, F.col("x0"))
          .when(a * b < 0, F.col("x0") + (F.lit(level) - F.col("y0")) / (F.col("y1") - F.col("y0"))
                * (F.col("x1") - F.col("x0"))))
    return (steps.withColumn("at", at).where("at is not null")
            .groupBy(*by).agg(F.min_by("at", "x0").alias("crossing")))


def crossover_summary(crossings: DataFrame, seeds: DataFrame, value: str = "crossing",
                      seed: str = "seed") -> DataFrame:
    """One row: mean and CI over the seeds that crossed, crossed and total seeds."""
    per_seed = seeds.select(seed).distinct().join(crossings, seed, "left")
    return mean_ci(per_seed, value, rows="n_seeds").withColumnRenamed("n", "n_crossed")
