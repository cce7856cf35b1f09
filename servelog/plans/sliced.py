"""Ordered scans that survive hot groups.

``row_number``, ``lag`` and running sums over ``partition by group order by o``
put a whole group into one task. When one group holds a third of a log that is
the job. Here every group is cut into *slices*: a column that never decreases
along the order (a day, ``seq div 1_000_000``). The window runs inside
(group, slice), and what earlier slices contribute comes from one aggregated row
per slice, which joins the slice's window. Rows are shuffled once, by (group, slice);
the summaries are pre-aggregated map-side. A NULL group is a group, as in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 1_000_000
QUANTILES = 1024


def dense_slice(seq: str | Column, rows: int = SLICE_ROWS) -> Column:
    """Slice of a dense integer order key: at most ``rows`` rows per slice."""
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(col / F.lit(rows)).cast("long")


def even_slice(df: DataFrame, order: str, rows: int = SLICE_ROWS) -> Column:
    """Slice of any integer order column so that a slice of the whole table holds about ``rows``
    rows, however unevenly the values lie: bounds are approximate quantiles from one
    aggregate. Equal values share a slice. From ``QUANTILES`` slices on, each range
    between two quantiles is cut into equal widths."""
    cuts = [F.lit(k / QUANTILES) for k in range(1, QUANTILES)]
    seen = df.agg(F.min(order).alias("a"), F.max(order).alias("z"), F.count(order).alias("n"),
                  F.percentile_approx(order, F.array(*cuts), 20 * QUANTILES).alias("q")).first()
    wanted = -(-seen["n"] // rows)
    if wanted <= 1:
        return F.lit(0).cast("long")
    marks = [seen["q"][k * QUANTILES // wanted - 1] for k in range(1, wanted) if k * QUANTILES // wanted] \
        if wanted < QUANTILES else seen["q"]
    bounds = sorted({seen["a"], *marks})
    each = max(1, -(-wanted // QUANTILES))
    return _place_among(F.col(order), bounds, seen["z"] + 1, each)


def _place_among(value: Column, bounds: list[int], end: int, each: int) -> Column:
    """Number of the range [bound, next bound) that holds ``value``, by binary search; with
    ``each`` above 1 every range counts as so many of equal width."""
    table = F.array(*[F.lit(b).cast("long") for b in [*bounds, end]])
    step, steps = 1, []
    while step < len(bounds):
        steps.insert(0, step)
        step *= 2
    higher = lambda at, s: at + F.when(
        F.coalesce(F.get(table, at + s) <= value, F.lit(False)) & (at + s < len(bounds)), s).otherwise(0)
    at = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), higher) if steps else F.lit(0)
    if each == 1:
        return at.cast("long")
    inside = F.struct(at.alias("at"))
    width = lambda k: F.get(table, k + 1) - F.get(table, k)
    share = lambda k: F.floor((value - F.get(table, k)) * each / width(k))
    return F.get(F.transform(F.array(inside), lambda s: s["at"] * each + share(s["at"])), F.lit(0)).cast("long")


def magnitude_slice(value: str | Column, per_unit: int = 64) -> Column:
    """Slice for a column ordered by value: equal steps of its logarithm."""
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * per_unit).cast("long")


def _earlier(group):
    return (Window.partitionBy(*group).orderBy("__s")
            .rowsBetween(Window.unboundedPreceding, -1))


def _running(df: DataFrame, group: Sequence[str], order: Sequence, value: Column,
             out: str) -> DataFrame:
    """Running sum of ``value`` by slice. What earlier slices add enters as one row that is
    first in its slice, so no join is needed and NULL groups carry over as well."""
    rows = df.withColumns({"__add": value, "__own": F.lit(1)})
    before = (rows.groupBy(*group, "__s").agg(F.sum("__add").alias("__n"))
              .withColumn("__add", F.sum("__n").over(_earlier(group)))
              .where(F.col("__add").isNotNull()).drop("__n").withColumn("__own", F.lit(0)))
    upto = (Window.partitionBy(*group, "__s").orderBy("__own", *order)
            .rowsBetween(Window.unboundedPreceding, 0))
    return (rows.unionByName(before, allowMissingColumns=True)
            .withColumn(out, F.sum("__add").over(upto)).where("__own = 1")
            .drop("__s", "__add", "__own"))


def sliced_row_number(df: DataFrame, group: Sequence[str], order: Sequence,
                      slice_: Column, out: str) -> DataFrame:
    return _running(df.withColumn("__s", slice_), group, order, F.lit(1).cast("long"), out)


def sliced_running_sum(df: DataFrame, group: Sequence[str], order: Sequence,
                       slice_: Column, value: str, out: str) -> DataFrame:
    """Inclusive running sum; ``order`` must be total for a definite result."""
    return _running(df.withColumn("__s", slice_), group, order, F.col(value), out)


def _neighbour(df, group, order, slice_, cols, out, forward):
    """Struct of ``cols`` from the previous or next row of the group."""
    rows = df.withColumn("__s", slice_).withColumns(
        {"__by": F.struct(*order), "__payload": F.struct(*cols), "__own": F.lit(1)})
    if len(order) == 1 and list(cols) == list(order):
        # A plain min or max stays a hash aggregate.
        edge = F.struct((F.min if forward else F.max)(order[0]).alias(order[0]))
    else:
        edge = (F.min_by if forward else F.max_by)("__payload", "__by")
    step = F.lead if forward else F.lag
    # The row next door in another slice takes part as one more row of this one.
    around = (rows.groupBy(*group, "__s").agg(edge.alias("__e"))
              .withColumn("__payload", step("__e").over(Window.partitionBy(*group).orderBy("__s")))
              .where(F.col("__payload").isNotNull()).drop("__e")
              .withColumn("__own", F.lit(2 if forward else 0)))
    here = Window.partitionBy(*group, "__s").orderBy("__own", "__by")
    return (rows.unionByName(around, allowMissingColumns=True)
            .withColumn(out, step("__payload").over(here)).where("__own = 1")
            .drop("__s", "__by", "__payload", "__own"))


def sliced_lag(df, group, order, slice_, cols, out):
    """``lag(struct(cols))`` by ``order`` (ascending plain columns) as ``out``."""
    return _neighbour(df, group, order, slice_, cols, out, forward=False)


def sliced_lead(df, group, order, slice_, cols, out):
    return _neighbour(df, group, order, slice_, cols, out, forward=True)
