"""Sliced scans, percentiles and dominance counts against plain forms."""

import random
from collections import OrderedDict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from servelog.operators.locality import lru_hits, reuse_distance
from servelog.plans.dominance import count_below
from servelog.plans.quantiles import exact_percentiles
from servelog.plans.sliced import (dense_slice, sliced_lag, sliced_lead, sliced_row_number,
                                   sliced_running_sum)


def _skewed(spark, n=3000):
    """Half of the rows belong to one group."""
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 37))
    return spark.range(n).select(F.col("id").alias("seq"), key.alias("g"),
                                 (F.col("id") * 7919 % 1009).alias("v"))


def test_sliced_scans_equal_windows(spark):
    df = _skewed(spark)
    w = Window.partitionBy("g").orderBy("seq")
    want = df.select("seq", F.row_number().over(w).cast("long"), F.sum("v").over(w),
                     F.lag("v").over(w), F.lead("v").over(w)).collect()
    s = dense_slice("seq", 100)
    got = sliced_row_number(df, ["g"], ["seq"], s, "rn")
    got = sliced_running_sum(got, ["g"], ["seq"], s, "v", "rs")
    got = sliced_lag(got, ["g"], ["seq"], s, ["v"], "lg")
    got = sliced_lead(got, ["g"], ["seq"], s, ["v"], "ld")
    got = got.select("seq", "rn", "rs", "lg.v", "ld.v").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(map(tuple, want), key=lambda r: r[0])


def test_exact_percentiles_equal_builtin(spark):
    df = _skewed(spark).withColumn("x", F.col("v") / 3.0 - 50)
    got = exact_percentiles(df, ["g"], "x", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0})
    want = df.groupBy("g").agg(*[F.percentile("x", p) for p in (0.0, 0.5, 0.99, 1.0)])
    expected = {r[0]: tuple(r)[1:] for r in want.collect()}
    for row in got.collect():
        np.testing.assert_allclose(tuple(row)[2:], expected[row["g"]], rtol=1e-12)


def test_brackets_are_narrowed_to_few_values(spark):
    """Before the sort every bracket of a hot group of 40,000 unlike values holds 8 at most."""
    from servelog.plans import quantiles
    df = spark.range(40_000).select(F.lit(None).cast("string").alias("g"), F.lit(0).alias("__k"), F.lit(0).alias("__side"),
                                    F.col("id").cast("double").alias("__v"), F.lit(2).cast("long").alias("__c"))
    df = df.withColumns({"__in": F.col("__v"), "__min": F.col("__v"), "__max": F.col("__v")})
    got = quantiles._narrowed(df, ["g"], [0.25], 8)
    assert got.where("__side = 0").count() <= 8 and got.count() <= 14
    assert got.agg(F.sum("__c")).first()[0] == 80_000
    inside = got.where("__side = 0").agg(F.min("__v"), F.max("__v")).first()
    assert inside[0] <= 9_999 and inside[1] >= 10_000  # on both sides of rank 19,999.75, two rows a value
    nearest = got.groupBy("__side").agg(F.min("__v").alias("a"), F.max("__v").alias("z")).collect()
    ends = {r["__side"]: (r.a, r.z) for r in nearest}
    assert ends[-1][1] == inside[0] - 1 and ends[1][0] == inside[1] + 1


def test_percentiles_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([("a", 4.0), ("b", None)], "g string, x double")
    rows = exact_percentiles(df, ["g"], "x", {"p50": 0.5}).collect()
    assert [tuple(r) for r in rows] == [("a", 1, 4.0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=40), st.data())
def test_count_below(values, data):
    asks = data.draw(st.lists(st.tuples(st.integers(0, len(values)), st.integers(0, 60)), max_size=20))
    got = count_below(np.array(values, np.int64), np.array([a for a, _ in asks], np.int64),
                      np.array([b for _, b in asks], np.int64))
    assert got.tolist() == [sum(v < b for v in values[:a]) for a, b in asks]


def _lru_replay(rows, capacity):
    caches, hits = {}, {}
    for seq, worker, key in rows:
        cache = caches.setdefault(worker, OrderedDict())
        hits[seq] = key in cache
        cache[key] = None
        cache.move_to_end(key)
        if len(cache) > capacity:
            cache.popitem(last=False)
    return hits


def test_reuse_distance_over_many_slices_is_exact_lru(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else f"w{rng.randrange(3)}",
             f"p{int(rng.paretovariate(0.7)) % 60}") for i in range(1500)]
    df = spark.createDataFrame(rows, "seq long, worker_id string, prefix_hash string")
    for capacity, width in ((1, 10_000), (5, 40), (20, 101)):
        got = lru_hits(df, capacity, slice_=dense_slice("seq", 64), slice_positions=width)
        assert {r["seq"]: r["hit"] for r in got.collect()} == _lru_replay(rows, capacity)


def test_reuse_distance_values(spark):
    rows = [(i, "w", k) for i, k in enumerate("ABCABBDA")]
    df = spark.createDataFrame(rows, "seq long, worker_id string, k string")
    got = reuse_distance(df, "worker_id", "k", ["seq"], dense_slice("seq", 3), 2)
    assert [r["distance"] for r in got.orderBy("seq").collect()] == [
        None, None, None, 2, 2, 0, None, 2]


def test_slices_are_even_however_values_lie(spark):
    """99 % of the rows in one minute of a year, an early outlier, and ties."""
    from servelog.plans.sliced import _place_among, even_slice
    minute, year = 60_000_000, 365 * 86_400_000_000
    burst = F.lit(year // 2) + F.col("id") * 6_001 % minute
    ts = F.when(F.col("id") == 0, -year).when(F.col("id") % 100 == 0, F.col("id") * (year // 100_000)).otherwise(burst)
    log = spark.range(100_000).select(ts.alias("ts"))
    for rows, most in ((5_000, 10_000), (700, 1_400), (200, 400), (40, 120)):  # the last: more slices than quantiles
        got = log.select(even_slice(log, "ts", rows).alias("s"), "ts").groupBy("s").agg(
            F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z")).orderBy("s").collect()
        assert max(r.n for r in got) <= most
        assert all(x.z < y.a for x, y in zip(got, got[1:]))
    tied = spark.range(1000).select((F.col("id") % 3).alias("ts"))
    assert tied.select(even_slice(tied, "ts", 10).alias("s")).distinct().count() <= 3
    bounds = [-5, 0, 7, 8, 100]
    values = spark.range(-5, 150).select("id", _place_among(F.col("id"), bounds, 150, 1).alias("k")).collect()
    assert all(r.k == sum(b <= r.id for b in bounds) - 1 for r in values)
    none = spark.createDataFrame([], "ts long")
    assert none.select(even_slice(none, "ts")).count() == 0
