"""Validation, normalisation and derived columns of request rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelog.plans.sliced import dense_slice, sliced_row_number
from servelog.sources.schemas import PARAM_DEFAULTS, PARAMS

# Accepted ranges and choices of a request.
MAX_TOKENS = (1, 8192)
TEMPERATURE = (0.0, 2.0)
TOP_P = (0.0, 1.0)
MODES = ("sync", "async")
PRIORITIES = ("high", "default")
# Latency budget per priority in milliseconds, queue watermarks.
BUDGETS_MS = {"high": 5.0, "default": 50.0}
LOW_WATERMARK, HIGH_WATERMARK = 2000, 10000


def validate_requests(df: DataFrame) -> DataFrame:
    """Add ``reasons`` (array of failed checks) and ``is_valid``."""
    def failed(ok: Column, reason: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason))

    checks = [
        failed(F.col("model").isNotNull(), "model"),
        failed(F.col("input").isNotNull(), "input"),
        failed(F.col("max_tokens").between(*MAX_TOKENS), "max_tokens"),
        failed(F.col("temperature").between(*TEMPERATURE), "temperature"),
        failed(F.col("top_p").between(*TOP_P), "top_p"),
        failed(F.col("mode").isin(*MODES), "mode"),
        failed(F.col("priority").isin(*PRIORITIES), "priority"),
    ]
    return (df.withColumn("reasons", F.array_compact(F.array(*checks)))
            .withColumn("is_valid", F.size("reasons") == 0))


def normalise_params(df: DataFrame, params: str = "params") -> DataFrame:
    """JSON ``params`` -> struct ``p`` with absent fields defaulted."""
    parsed = F.from_json(F.col(params), PARAMS)
    fields = [F.coalesce(parsed[name], F.lit(default)).alias(name)
              for name, default in PARAM_DEFAULTS.items()]
    return df.withColumn("p", F.struct(*fields))


def resolve_payload(df: DataFrame) -> DataFrame:
    """Union payload -> (kind, payload); error beats token beats output."""
    kind = (F.when(F.col("error").isNotNull(), "error")
            .when(F.col("token").isNotNull(), "token").otherwise("output"))
    return (df.withColumn("kind", kind)
            .withColumn("payload", F.coalesce("error", "token", "output", F.lit(""))))


def deadline_columns(df: DataFrame, now: Column, budgets: Mapping[str, float] = BUDGETS_MS,
                     enqueue: str = "enqueue_ms") -> DataFrame:
    """deadline = enqueue + budget of the priority; slack = deadline - now."""
    budget = F.lit(None).cast("double")
    for priority, value in budgets.items():
        budget = F.when(F.col("priority") == priority, F.lit(float(value))).otherwise(budget)
    return (df.withColumn("deadline", F.col(enqueue) + budget)
            .withColumn("slack", F.col("deadline") - now)
            .withColumn("overdue", F.col("slack") <= 0))


def admission_class(df: DataFrame, low: int = LOW_WATERMARK, high: int = HIGH_WATERMARK,
                    depth: str = "depth") -> DataFrame:
    if not 0 <= low < high:
        raise ValueError("need 0 <= low < high")
    d = F.col(depth)
    return df.withColumn("admission", F.when(d >= high, "shed")
                         .when(d >= low, "degraded").otherwise("accept"))


def steady_state(df: DataFrame, warmup: int, by: Sequence[str] = (), order: str = "seq",
                 completed: Column | None = None) -> DataFrame:
    """Completed rows whose 0-based arrival index inside ``by`` is >= ``warmup``.

    The index counts every arrival, completed or not.
    """
    keys = list(by) or ["__all"]
    src = df if by else df.withColumn("__all", F.lit(0))
    rows = sliced_row_number(src, keys, [order], dense_slice(order), "arrival_index")
    rows = rows.withColumn("arrival_index", F.col("arrival_index") - 1)
    keep = F.col("arrival_index") >= warmup
    if completed is not None:
        keep = keep & completed
    rows = rows.where(keep)
    return rows if by else rows.drop("__all")
