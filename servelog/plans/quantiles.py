"""Exact interpolated percentiles without a per-group value buffer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelog.plans.joins import null_safe_join
from servelog.session import cut

ACCURACY = 10_000
#: Distinct values of a bracket that one task sorts.
BRACKET_VALUES = 1_000_000
#: Parts a bracket with more of them is cut into.
PARTS = 256


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, percentiles: Mapping[str, float],
                      accuracy: int = ACCURACY, bracket_values: int = BRACKET_VALUES) -> DataFrame:
    """One row per group: ``by``, ``n`` and one column per percentile name.

    A first pass brackets each percentile: the approximate ones a little below and above
    it, whose ranks are off by ``n / accuracy`` at most. A second pass counts map-side what
    lies below a bracket, and by value what lies inside, about ``6 / accuracy`` of the rows.
    Brackets of more than ``bracket_values`` distinct values are narrowed to one part or two of
    ``PARTS`` equal ones until none is left. Only what is inside is sorted, so neither
    a hot group nor a narrow range of values gathers in a task.
    """
    keys = list(by) or ["__all"]
    src = df if by else df.withColumn("__all", F.lit(0))
    src = src.select(*keys, F.col(value).cast("double").alias("__x")).where("__x IS NOT NULL")
    points = [float(p) for p in percentiles.values()]
    edges = [min(1.0, max(0.0, p + side * 3 / accuracy)) for p in points for side in (-1, 1)]
    brackets = cut(src.groupBy(*keys).agg(F.percentile_approx("__x", edges, accuracy).alias("__e"),
                                          F.count(F.lit(1)).alias("__n")))
    spans = F.array(*[F.struct(F.element_at("__e", 2 * k + 1).alias("lo"), F.element_at("__e", 2 * k + 2).alias("hi"))
                      for k in range(len(points))])
    rows = (null_safe_join(src, brackets.drop("__n"), keys)
            .select(*keys, F.posexplode(spans).alias("__k", "__b"), F.col("__x").alias("__min"),
                    F.col("__x").alias("__max"), F.lit(1).cast("long").alias("__c")))
    counts = _outside_counted(rows, keys)
    # Six steps apart and two ranks off at most: a bracket holds no more than 8 / accuracy of the rows.
    most = brackets.agg(F.max("__n").alias("n")).first()["n"] or 0
    if 8 * most / accuracy > bracket_values:
        counts = _narrowed(counts, keys, points, bracket_values)
    group = Window.partitionBy(*keys, "__k")
    rank = F.sum("__c").over(group.orderBy("__side", "__v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*keys, "__k", "__side", "__v", F.sum("__c").over(group).alias("n"), rank.alias("__cum"))
    at = _rank(points)
    found = placed.groupBy(*keys, "__k", "n").agg(
        F.min(F.when(F.col("__cum") > F.floor(at), F.col("__v"))).alias("lo"),
        F.min(F.when(F.col("__cum") > F.ceil(at), F.col("__v"))).alias("hi"))
    between = F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("__k") == k, between)).alias(name) for k, name in enumerate(percentiles)
    ]).select(*by, "n", *percentiles)


def _rank(points: Sequence[float]) -> Column:
    """Fractional rank from 0 of percentile ``__k`` among ``n`` rows."""
    return (F.col("n") - 1) * F.element_at(F.array(*map(F.lit, points)), F.col("__k") + 1)


def _outside_counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, __k, __min, __max, __c) against their bracket ``__b``: one row for all below it,
    one for all above, one per value ``__v`` inside. Of those outside the nearest value is
    kept: a percentile may lie between it and the bracket."""
    side = F.when(F.col("__max") < F.col("__b.lo"), -1).when(F.col("__min") > F.col("__b.hi"), 1).otherwise(0)
    inside = F.when(F.col("__side") == 0, F.col("__min"))
    return (rows.withColumn("__side", side).groupBy(*keys, "__k", "__side", inside.alias("__in"))
            .agg(F.sum("__c").alias("__c"), F.max("__max").alias("__max"), F.min("__min").alias("__min"))
            .withColumn("__v", F.when(F.col("__side") < 0, F.col("__max")).otherwise(F.col("__min"))))


def _narrowed(counts: DataFrame, keys: Sequence[str], points: Sequence[float], most: int) -> DataFrame:
    """``counts`` with brackets of ``most`` distinct values at most.

    A bracket is cut at quantiles of its distinct values, so each round leaves some two parts
    of ``PARTS``, however the values lie. Rounds read the written counts, not the table; the
    driver sees whether any bracket is left. Two parts of fewer than eight values may be all.
    """
    at, most = [*keys, "__k"], max(most, 8)
    while True:
        counts = cut(counts)
        inside = counts.where("__side = 0")
        wide = inside.groupBy(*at).agg(F.count(F.lit(1)).alias("__m"), F.percentile_approx(
            "__v", [k / PARTS for k in range(PARTS + 1)], 20 * PARTS).alias("__cuts")).where(F.col("__m") > most)
        wide = cut(wide)
        if wide.isEmpty():
            return counts
        totals = counts.groupBy(*at).agg(F.sum("__c").alias("n"), F.sum(
            F.when(F.col("__side") < 0, F.col("__c")).otherwise(0)).alias("__below"))
        # Part p holds the values above cut p - 1, up to cut p.
        part = F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
        parts = (null_safe_join(inside, wide, at).groupBy(*at, part.alias("__p"))
                 .agg(F.sum("__c").alias("__c"), F.min("__v").alias("lo"), F.max("__v").alias("hi")))
        upto = F.col("__below") + F.sum("__c").over(
            Window.partitionBy(*at).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0))
        ranked = null_safe_join(parts, totals, at).withColumn("__upto", upto)
        rank = _rank(points)
        # The parts with the ranks on both sides of the percentile.
        needed = (F.col("__upto") > F.floor(rank)) & (F.col("__upto") - F.col("__c") <= F.ceil(rank))
        spans = ranked.where(needed).groupBy(*at).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        spans = cut(spans.select(*at, F.struct("lo", "hi").alias("__b")))
        if spans.isEmpty():
            return counts
        rows = null_safe_join(counts, spans, at, "left").withColumn("__old", F.col("__side"))
        moved = _outside_counted(rows.where("__old = 0 AND __b IS NOT NULL")
                                 .select(*at, "__b", "__min", "__max", "__c"), keys)
        kept = rows.where("__old <> 0 OR __b IS NULL").select(*moved.columns)
        counts = moved.union(kept)
