"""Placement policies side by side over one log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelog.operators.locality import first_touch
from servelog.operators.metrics import policy_summary
from servelog.operators.placement import CAP_SWEEP, balanced_assign, takers
from servelog.session import cut


def _choice(policy: str, cap_factor: Column, worker: Column) -> Column:
    return F.struct(F.lit(policy).alias("policy"), cap_factor.alias("cap_factor"), worker.alias("worker_id"))


def policy_rows(log: DataFrame, key: str, workers: DataFrame, window: Column,
                caps: Sequence[float] = CAP_SWEEP, **options) -> DataFrame:
    """Rows of the log once per policy: policy, cap_factor, worker_id and hit.

    ``balanced`` (cap 0) deals rows out in turn, ``affinity`` is the bounded-load
    placement at each cap; all caps share the same rounds. Rows that no worker may take
    stay, without a worker and without a hit.
    """
    swept = takers(log, key, workers, caps, window, **options).select("seq", F.transform(
        "takes", lambda t: _choice("affinity", t["cap_factor"], t["worker_id"])).alias("takes"))
    dealt = balanced_assign(log, workers, window).select(
        "seq", F.array(_choice("balanced", F.lit(0.0), F.col("worker_id"))).alias("takes"))
    # A row of the log is joined once for all caps, and written before it counts once for each.
    joined = cut(dealt.unionByName(swept).join(log, "seq"))
    rows = joined.select(*[c for c in joined.columns if c != "takes"], F.inline("takes"))
    hits = first_touch(rows, ["policy", "cap_factor", "worker_id", key])
    return hits.withColumn("hit", F.col("hit") & F.col("worker_id").isNotNull())


def cap_sweep(log: DataFrame, key: str, workers: DataFrame, window: Column,
              caps: Sequence[float] = CAP_SWEEP, slots: int = 1,
              steady: Column | None = None, **options) -> DataFrame:
    """One summary row per policy and cap over the steady-state rows.

    The cache is warmed by every row; only rows where ``steady`` holds count. The rows
    are written once: the summary reads them for its bounds, percentiles and sums.
    """
    rows = policy_rows(log, key, workers, window, caps, **options)
    rows = rows if steady is None else rows.where(steady)
    return policy_summary(cut(rows), workers.count(), slots)
