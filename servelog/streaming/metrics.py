"""Windowed metrics on streams; rows later than the watermark are dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelog.operators.metrics import HISTOGRAM_BOUNDS, PERCENTILES


def streaming_metrics(rows: DataFrame, watermark: str, window: str = "1 minute",
                      slide: str | None = None, by: Sequence[str] = ("status",),
                      ts: str = "ts") -> DataFrame:
    """Rate, queue wait and total time per window and ``by``, and the mean of ``batch_size``
    where the rows have it.

    Only running sums are kept per window and group, so state does not grow
    with the traffic.
    """
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    size = ["batch_size"] if "batch_size" in rows.columns else []
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1_000_000
    return (rows.withWatermark(ts, watermark).groupBy(span.alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("n"), F.avg("queue_wait_ms").alias("mean_queue_wait_ms"),
                 F.max("queue_wait_ms").alias("max_queue_wait_ms"),
                 F.avg("total_ms").alias("mean_total_ms"),
                 *[F.avg(c).alias(f"mean_{c}") for c in size])
            .select(F.col("w.start").alias("window_start"), *by, "n",
                    (F.col("n") / seconds).alias("rate"), "mean_queue_wait_ms",
                    "max_queue_wait_ms", "mean_total_ms", *[f"mean_{c}" for c in size]))


def streaming_quantiles(rows: DataFrame, watermark: str, value: str, window: str = "1 minute",
                        slide: str | None = None, by: Sequence[str] = ("status",),
                        quantiles: Mapping[str, float] = PERCENTILES,
                        bounds: Sequence[float] = HISTOGRAM_BOUNDS, ts: str = "ts") -> DataFrame:
    """(window_start, by…, n, one column per quantile) of ``value``, interpolated in buckets as
    ``histogram_quantile`` does, for every window the watermark has passed.

    The state of a window and group is one count per bucket. NULLs are not counted; a
    group of NULLs alone has no quantiles.
    """
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    les = [*map(float, bounds), float("inf")]
    counts = [F.count_if(F.col(value) <= le).alias(f"__b{i}") for i, le in enumerate(les)]
    closed = rows.withWatermark(ts, watermark).groupBy(span.alias("w"), *by).agg(*counts)
    cumulative = F.array(*[F.col(f"__b{i}") for i in range(len(les))])
    return (closed.withColumn("__c", cumulative)
            .select(F.col("w.start").alias("window_start"), *by, F.col(f"__b{len(bounds)}").alias("n"),
                    *[_bucket_quantile(F.col("__c"), les, q).alias(name) for name, q in quantiles.items()]))


def _bucket_quantile(cumulative: Column, les: Sequence[float], q: float) -> Column:
    """Place of the rank in the first bucket that reaches it; the last finite bound beyond all."""
    rank = F.lit(float(q)) * F.get(cumulative, F.lit(len(les) - 1))
    steps = F.array(*[F.struct(
        F.lit(le).alias("le"), F.lit(les[i - 1] if i else 0.0).alias("lo"), F.get(cumulative, F.lit(i)).alias("c"),
        (F.get(cumulative, F.lit(i - 1)) if i else F.lit(0).cast("long")).alias("below")) for i, le in enumerate(les)])
    reached = F.filter(steps, lambda s: (s["c"] >= rank) & (s["c"] > 0))

    def place(s: Column) -> Column:
        width = s["c"] - s["below"]
        return (F.when(s["le"] == float("inf"), s["lo"]).when(width == 0, s["le"])
                .otherwise(s["lo"] + (s["le"] - s["lo"]) * (rank - s["below"]) / width))
    return F.get(F.transform(F.slice(reached, 1, 1), place), F.lit(0))


def streaming_sessions(heartbeats: DataFrame, ttl: str = "15 seconds", watermark: str = "1 minute",
                       worker: str = "worker_id", ts: str = "ts") -> DataFrame:
    """Stream form of worker liveness: one row per closed up-interval."""
    return (heartbeats.withWatermark(ts, watermark)
            .groupBy(F.session_window(ts, ttl).alias("s"), worker)
            .agg(F.count(F.lit(1)).alias("beats"))
            .select(worker, F.unix_micros("s.start").alias("up_from_us"),
                    F.unix_micros("s.end").alias("up_until_us"), "beats"))
