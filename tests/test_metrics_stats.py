import math

import pytest
from pyspark.sql import functions as F

from servelog.operators import metrics, stats


def test_histogram_quantile_cases(spark):
    rows = [("a", 0.5, 0), ("a", 1.0, 10), ("a", float("inf"), 10), ("b", 0.5, 1), ("b", 1.0, 1),
            ("b", float("inf"), 100), ("c", 0.5, 0), ("c", float("inf"), 0)]
    hist = spark.createDataFrame(rows, "s string, le double, cumulative long")
    got = {r["s"]: r["quantile"] for r in metrics.histogram_quantile(hist, ["s"], 0.5).collect()}
    assert got == {"a": 0.75, "b": 1.0, "c": None}


def test_imbalance_counts_idle_workers(spark):
    df = spark.createDataFrame([("w0",)] * 6 + [("w1",)] * 2, "worker_id string")
    assert tuple(metrics.load_imbalance(df, 2).first()) == (1.5, 3.0)
    assert tuple(metrics.load_imbalance(df, 4).first()) == (3.0, 6.0)


def test_depth_never_goes_negative_and_ends_at_zero(spark):
    df = spark.createDataFrame([(0, 0, 5), (1, 5, 5), (2, 5, 9), (3, 9, 10)], "seq long, a long, z long")
    got = metrics.inflight(df.withColumn("g", F.lit("g")), ["g"], F.col("a"), F.col("z"), slice_us=4)
    depths = [r["depth"] for r in got.orderBy("t_us", "phase", "seq").collect()]
    assert min(depths) == 0 and depths[-1] == 0 and max(depths) == 2
    assert metrics.peak(got, ["g"]).first()["peak"] == 2


def test_desired_workers_clamps_and_stabilises(spark):
    rows = [(i * 15_000_000, d) for i, d in enumerate([0, 26, 1000, 1000, 1000, 0, 0])]
    df = spark.createDataFrame(rows, "window_us long, depth long")
    got = metrics.desired_workers(df).orderBy("window_us").collect()
    assert [r["desired"] for r in got] == [2, 2, 20, 20, 20, 2, 2]
    assert [r["scale_up_to"] for r in got] == [2, 2, 2, 2, 20, 2, 2]
    assert [r["scale_down_to"] for r in got] == [2, 2, 20, 20, 20, 20, 20]


def test_topk_mass(spark):
    df = spark.createDataFrame([(p,) for p in "aaaabbc"], "prefix_hash string")
    assert tuple(metrics.topk_mass(df, 2).first()) == (7, 3, 6 / 7)
    assert tuple(metrics.topk_mass(df.limit(0), 2).first())[2] == 0.0


def test_linear_fit_on_the_latency_law_and_constant_y(spark):
    df = spark.createDataFrame([(g, float(b), 18 + 7.5 * b if g == "law" else 3.0)
                                for g in ("law", "flat") for b in (1, 4, 8, 16)],
                               "g string, x double, y double")
    got = {r["g"]: r for r in stats.linear_fit(df, "x", "y", ["g"]).collect()}
    assert got["law"]["slope"] == pytest.approx(7.5) and got["law"]["r2"] == pytest.approx(1)
    assert got["flat"]["r2"] == 1.0 and got["flat"]["slope"] == pytest.approx(0)


def test_mean_ci(spark):
    rows = [("one", 5.0), ("two", 1.0), ("two", 3.0), ("none", None), ("two", float("nan"))]
    rows += [("many", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["mean"], r["ci"]) for r in stats.mean_ci(df, "v", ["g"]).collect()}
    assert got["one"] == (1, 5.0, 0.0) and got["none"] == (0, None, None)
    assert got["two"][:2] == (2, 2.0)
    assert got["two"][2] == pytest.approx(12.706 * math.sqrt(2) / math.sqrt(2))
    assert got["many"][2] == pytest.approx(1.96 * 11.690451944500122 / math.sqrt(40))


def test_crossover_exact_interpolated_and_absent(spark):
    grids = {1: [0.8, 1.0, 1.2], 2: [0.5, 0.9, 1.1], 3: [1.5, 1.4, 1.3], 4: [0.8, 0.9, 1.0]}
    rows = [(s, 100 * (i + 1), y) for s, ys in grids.items() for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "seed int, x int, y double")
    cross = stats.crossover(df, "x", "y")
    got = {r["seed"]: r["crossing"] for r in cross.collect()}
    assert set(got) == {1, 2} and got[1] == 200.0 and got[2] == pytest.approx(250.0)
    summary = stats.crossover_summary(cross, df).first()
    assert (summary["n_crossed"], summary["n_seeds"]) == (2, 4)


def test_best_policy_tie_takes_the_smaller_cap(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 9.0), (1, "b", 1.25, 9.0), (1, "c", 1.5, 10.0)],
                               "seed int, policy string, cap double, p99 double")
    assert stats.best_policy(df, ["seed"]).first()["policy"] == "b"
    assert stats.speedup(df, "c", ["seed"]).first()["speedup"] == pytest.approx(10 / 9)
