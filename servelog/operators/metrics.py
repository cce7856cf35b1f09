"""Rates, latency, histograms, balance, utilisation and queue metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelog.plans.joins import null_safe_join
from servelog.plans.quantiles import exact_percentiles
from servelog.plans.sliced import even_slice, sliced_lead, sliced_running_sum

# Default histogram bounds in seconds, latency percentiles,
# autoscaling target and limits, stabilisation windows in seconds.
HISTOGRAM_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75,
                    1.0, 2.5, 5.0, 7.5, 10.0)
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
TARGET_DEPTH, MIN_WORKERS, MAX_WORKERS = 25, 2, 20
SCALE_UP_WINDOW_S, SCALE_DOWN_WINDOW_S = 30, 120


def _time_slice(df: DataFrame, ts_us: str, slice_us: int | None) -> Column:
    if slice_us is None:
        return even_slice(df, ts_us)
    return F.floor(F.col(ts_us) / slice_us)


def request_rate(df: DataFrame, window: str = "1 minute", slide: str | None = None,
                 by: Sequence[str] = ("status",), ts: str = "ts") -> DataFrame:
    """(window_start, by…, n, rate per second) over tumbling or sliding windows."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1_000_000
    return (df.groupBy(span.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), *by, "n",
                    (F.col("n") / seconds).alias("rate")))


def latency_percentiles(df: DataFrame, by: Sequence[str], value: str = "total_ms",
                        percentiles: Mapping[str, float] = PERCENTILES,
                        since: Column | None = None, approximate: bool = False) -> DataFrame:
    """Exact interpolated percentiles; ``since`` filters e.g. the last hour."""
    rows = df if since is None else df.where(since)
    if not approximate:
        return exact_percentiles(rows, by, value, percentiles)
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"),
        *[F.percentile_approx(value, p).alias(name) for name, p in percentiles.items()])


def bucket_histogram(df: DataFrame, by: Sequence[str], value: str,
                     bounds: Sequence[float] = HISTOGRAM_BOUNDS) -> DataFrame:
    """(by…, le, cumulative, total_sum, total_count); the last ``le`` is infinity."""
    v = F.col(value)
    les = [*bounds, float("inf")]
    counts = [F.count_if(v <= le).alias(f"b{i}") for i, le in enumerate(les)]
    per = df.groupBy(*by).agg(F.sum(value).alias("total_sum"), F.count(value).alias("total_count"),
                              *counts)
    rows = F.array(*[F.struct(F.lit(float(le)).alias("le"), F.col(f"b{i}").alias("cumulative"))
                     for i, le in enumerate(les)])
    return per.select(*by, F.inline(rows), "total_sum", "total_count")


def histogram_quantile(hist: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """Quantile interpolated inside the bucket where the rank falls, after
    summing buckets over everything not in ``by``. In the infinite bucket the
    answer is the last finite bound."""
    summed = hist.groupBy(*by, "le").agg(F.sum("cumulative").alias("c"))
    # One row per bound: the window is as small as the list of bounds.
    order = Window.partitionBy(*by).orderBy("le")
    steps = summed.select(
        *by, "le", "c", F.coalesce(F.lag("c").over(order), F.lit(0)).alias("below"),
        F.coalesce(F.lag("le").over(order), F.lit(0.0)).alias("lo"),
        (F.lit(q) * F.max("c").over(Window.partitionBy(*by))).alias("rank"))
    width = F.col("c") - F.col("below")
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("rank") - F.col("below")) / width
    value = (F.when(F.col("le") == float("inf"), F.col("lo"))
             .when(width == 0, F.col("le")).otherwise(inside))
    hit = F.when((F.col("c") >= F.col("rank")) & (F.col("c") > 0), F.struct("le", value.alias("v")))
    return steps.groupBy(*by).agg(F.min(hit).alias("h")).select(*by, F.col("h.v").alias("quantile"))


def batch_size_stats(df: DataFrame, by: Sequence[str], size: str = "size") -> DataFrame:
    """(by…, n, mean_size, p50, p95, max_size); ``by`` names at least one column."""
    spread = exact_percentiles(df, by, size, {"p50": 0.5, "p95": 0.95})
    mean = df.groupBy(*by).agg((F.sum(size) / F.count(size)).alias("mean_size"),
                               F.max(size).alias("max_size"))
    return null_safe_join(spread, mean, list(by))


def batch_size_distribution(df: DataFrame, by: Sequence[str] = (), size: str = "size") -> DataFrame:
    return df.groupBy(*by, size).agg(F.count(F.lit(1)).alias("n_batches"))


def load_imbalance(df: DataFrame, n_workers: int, by: Sequence[str] = (),
                   worker: str = "worker_id", weight: Column | None = None) -> DataFrame:
    """(by…, max_over_mean, max_over_min); workers without rows count as 0 and a
    minimum of 0 makes the second ratio the maximum itself."""
    load = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    per = df.groupBy(*by, worker).agg(load.alias("load"))
    mean = F.sum("load") / F.lit(n_workers)
    low = F.when(F.count(F.lit(1)) < n_workers, F.lit(0.0)).otherwise(F.min("load"))
    high = F.max("load")
    return per.groupBy(*by).agg(
        (high / F.when(mean == 0, F.lit(1.0)).otherwise(mean)).alias("max_over_mean"),
        F.when(low == 0, high).otherwise(high / low).alias("max_over_min"))


def utilisation(df: DataFrame, n_workers: int, slots: int, by: Sequence[str] = (),
                busy: str = "busy_ms", start_us: str = "start_us", end_us: str = "end_us",
                worker: str = "worker_id") -> DataFrame:
    """(by…, busy_ms, span_ms, utilisation, busy_imbalance)."""
    per = df.groupBy(*by, worker).agg(F.sum(busy).alias("b"), F.min(start_us).alias("s"),
                                      F.max(end_us).alias("e"))
    span = F.greatest((F.max("e") - F.min("s")) / 1000.0, F.lit(1e-6))
    total = F.sum("b")
    return per.groupBy(*by).agg(
        total.alias("busy_ms"), span.alias("span_ms"),
        (total / (F.lit(n_workers * slots) * span)).alias("utilisation"),
        (F.max("b") / (total / F.lit(n_workers))).alias("busy_imbalance"))


def throughput(df: DataFrame, by: Sequence[str], start_us: str = "enqueue_us",
               end_us: str = "completed_us", tokens: str | None = None) -> DataFrame:
    """(by…, n, per_second[, tokens_per_second]) over first arrival to last end."""
    span = F.greatest((F.max(end_us) - F.min(start_us)) / 1_000_000.0, F.lit(1e-9))
    cols = [F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / span).alias("per_second")]
    if tokens:
        cols.append((F.sum(tokens) / span).alias("tokens_per_second"))
    return df.groupBy(*by).agg(*cols)


def step_events(df: DataFrame, keep: Sequence[str], up_us: Column, down_us: Column) -> DataFrame:
    """Rows (keep…, t_us, phase, delta): +1 where a row begins, -1 where it ends.

    ``phase`` orders events of one instant: intervals are half-open, so those
    that end leave before others begin, and an empty one leaves after it came.
    """
    leave = F.when(down_us > up_us, F.lit(-1)).otherwise(F.lit(1))
    both = F.array(
        F.struct(up_us.alias("t_us"), F.lit(0).alias("phase"), F.lit(1).cast("long").alias("delta")),
        F.struct(down_us.alias("t_us"), leave.alias("phase"), F.lit(-1).cast("long").alias("delta")))
    return df.select(*keep, F.inline(both)).where(F.col("t_us").isNotNull())


def queue_depth(events: DataFrame, by: Sequence[str],
                order: Sequence[str] = ("t_us", "phase", "seq"),
                slice_us: int | None = None) -> DataFrame:
    """Add ``depth`` after every event. Slices of the running sum are as wide as
    the traffic allows unless ``slice_us`` fixes them."""
    slice_ = _time_slice(events, "t_us", slice_us)
    keys = list(by) or ["__all"]
    src = events if by else events.withColumn("__all", F.lit(0))
    rows = sliced_running_sum(src, keys, order, slice_, "delta", "depth")
    return rows if by else rows.drop("__all")


def depth_per_window(depths: DataFrame, by: Sequence[str], window_us: int,
                     order: Sequence[str] = ("t_us", "phase", "seq")) -> DataFrame:
    """Last depth of each window."""
    start = F.floor(F.col("t_us") / window_us) * window_us
    return (depths.groupBy(*by, start.alias("window_us"))
            .agg(F.max_by("depth", F.struct(*order)).alias("depth")))


def inflight(df: DataFrame, by: Sequence[str], start_us: Column, end_us: Column,
             key: str = "seq", slice_us: int | None = None) -> DataFrame:
    """(by…, key, t_us, phase, delta, depth): rows running at once, at every change."""
    events = step_events(df, [*by, key], start_us, end_us)
    return queue_depth(events, by, ("t_us", "phase", key), slice_us)


def peak(depths: DataFrame, by: Sequence[str]) -> DataFrame:
    return depths.groupBy(*by).agg(F.max("depth").alias("peak"))


def run_hit_rate(hit: str = "hit") -> Column:
    return F.coalesce(F.avg(F.col(hit).cast("double")), F.lit(0.0))


def policy_summary(rows: DataFrame, n_workers: int, slots: int = 1,
                   by: Sequence[str] = ("policy", "cap_factor")) -> DataFrame:
    """One row per policy over its steady-state rows.

    Rows without a worker count in ``n`` and in no worker's load. ``rows`` need worker_id, hit, total_ms, queue_wait_ms, busy_ms, enqueue_us,
    completed_us and optionally batch_size.
    """
    by = list(by)
    span_s = F.greatest((F.max("e") - F.min("s")) / 1_000_000.0, F.lit(1e-9))
    sums = [F.count(F.lit(1)).alias("c"), F.count_if("hit").alias("h"),
            F.sum("queue_wait_ms").alias("q"), F.count("queue_wait_ms").alias("qn"),
            F.sum("busy_ms").alias("b"), F.min("enqueue_us").alias("s"),
            F.max("completed_us").alias("e")]
    has_size = "batch_size" in rows.columns
    if has_size:
        sums += [F.sum("batch_size").alias("z"), F.count("batch_size").alias("zn")]
    per = rows.groupBy(*by, "worker_id").agg(*sums)
    n, placed = F.sum("c"), F.col("worker_id").isNotNull()
    cols = [
        n.alias("n"), (F.sum("h") / n).alias("hit_rate"), (n / span_s).alias("throughput_rps"),
        (F.max(F.when(placed, F.col("c"))) / (F.sum(F.when(placed, F.col("c"))) / n_workers))
        .alias("load_imbalance"),
        (F.max(F.when(placed, F.col("b"))) / (F.sum(F.when(placed, F.col("b"))) / n_workers))
        .alias("busy_imbalance"),
        (F.sum("q") / F.sum("qn")).alias("mean_queue_wait_ms"),
        (F.sum(F.when(placed, F.col("b"))) / (n_workers * slots * span_s * 1000.0))
        .alias("utilisation")]
    if has_size:
        cols.append((F.sum("z") / F.sum("zn")).alias("mean_batch_size"))
    wide = per.groupBy(*by).agg(*cols)
    tail = exact_percentiles(rows, by, "total_ms", PERCENTILES).drop("n")
    return null_safe_join(wide, tail, by)


def per_worker_pivot(rows: DataFrame, policies: Sequence[str], policy: str = "policy",
                     worker: str = "worker_id") -> DataFrame:
    """worker x policy table of items and hit rate."""
    return (rows.groupBy(worker).pivot(policy, list(policies))
            .agg(F.count(F.lit(1)).alias("items"), run_hit_rate().alias("hit_rate")))


def topk_mass(df: DataFrame, k: int, prefix: str = "prefix_hash") -> DataFrame:
    """One row: share of traffic on the k hottest prefixes, distinct prefixes."""
    counts = df.groupBy(prefix).agg(F.count(F.lit(1)).alias("c"))
    none = F.lit(None).cast("long")
    hot = counts.orderBy(F.desc("c"), prefix).limit(k).agg(F.sum("c").alias("top"))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct_prefixes"))
    both = (total.withColumn("top", none).unionByName(
        hot.select(none.alias("n"), none.alias("distinct_prefixes"), "top")))
    return (both.agg(F.max("n").alias("n"), F.max("distinct_prefixes").alias("distinct_prefixes"),
                     F.max("top").alias("top"))
            .select("n", "distinct_prefixes",
                    F.coalesce(F.col("top") / F.col("n"), F.lit(0.0)).alias("topk_mass")))


def queue_wait_stats(df: DataFrame, by: Sequence[str], wait: str = "queue_wait_ms") -> DataFrame:
    mean = df.groupBy(*by).agg(F.avg(wait).alias("mean_wait"))
    return null_safe_join(exact_percentiles(df, by, wait, PERCENTILES), mean, list(by))


def desired_workers(depths: DataFrame, target: int = TARGET_DEPTH, low: int = MIN_WORKERS,
                    high: int = MAX_WORKERS, up_s: int = SCALE_UP_WINDOW_S,
                    down_s: int = SCALE_DOWN_WINDOW_S, by: Sequence[str] = (),
                    window_us: str = "window_us") -> DataFrame:
    """Recommendation per window and its stabilised forms.

    Scaling up takes the lowest recommendation of the last ``up_s`` seconds,
    scaling down the highest of the last ``down_s``. There is one row per
    metric window, so these windows grow with time, not with traffic.
    """
    keys = list(by) or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy(window_us)
    want = F.ceil(F.col("depth") / F.lit(target)).cast("int")
    rows = depths.withColumn("desired", F.least(F.greatest(want, F.lit(low)), F.lit(high)))
    return (rows
            .withColumn("scale_up_to", F.min("desired").over(
                order.rangeBetween(-up_s * 1_000_000, 0)))
            .withColumn("scale_down_to", F.max("desired").over(
                order.rangeBetween(-down_s * 1_000_000, 0))))


def status_lifecycle(events: DataFrame, job: str = "job_id", status: str = "status",
                     ts_us: str = "ts_us", seq: str = "seq",
                     slice_us: int | None = None) -> DataFrame:
    """(status, n, mean_ms_in_status, share): entries and time until the next
    event of the job; the share of ``error`` is the error rate."""
    rows = sliced_lead(events, [job], [ts_us, seq], _time_slice(events, ts_us, slice_us),
                       [ts_us], "__next")
    stay = F.col(f"__next.{ts_us}") - F.col(ts_us)
    # Whole microseconds are summed, so the mean does not depend on row order.
    per = rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"), (
        F.sum(stay) / F.count(stay) / 1000.0).alias("mean_ms_in_status"))
    # One row per status value.
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
