"""NULL keys are keys, as in GROUP BY and PARTITION BY: no row is lost or misnumbered."""

from fractions import Fraction

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from servelog.functions import steps
from servelog.operators import locality, metrics, placement, sweep
from servelog.plans.quantiles import exact_percentiles
from servelog.plans.sliced import dense_slice, sliced_lag, sliced_lead, sliced_row_number, sliced_running_sum


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 3 == 0 else f"k{i % 2}", i * 10 + 1) for i in range(60)]
    return spark.createDataFrame(data, "seq long, k string, v long")


def _groups(rows):
    out = {}
    for r in sorted(rows.collect()):
        out.setdefault(r["k"], []).append(r)
    return out


def test_sliced_scans(rows):
    for width in (1000, 7, 1):
        cut = dense_slice("seq", width)
        got = sliced_row_number(rows, ["k"], ["seq"], cut, "n")
        got = sliced_running_sum(got, ["k"], ["seq"], cut, "v", "s")
        got = sliced_lag(got, ["k"], ["seq"], cut, ["v"], "before")
        got = sliced_lead(got, ["k"], ["seq"], cut, ["v"], "after")
        assert got.columns == ["seq", "k", "v", "n", "s", "before", "after"] and got.count() == 60
        for group in _groups(got).values():
            total = 0
            for i, r in enumerate(group):
                total += r["v"]
                assert (r["n"], r["s"]) == (i + 1, total)
                assert r["before"] == (Row(v=group[i - 1]["v"]) if i else None)
                assert r["after"] == (Row(v=group[i + 1]["v"]) if i + 1 < len(group) else None)


def test_percentiles(rows):
    got = {r["k"]: r for r in exact_percentiles(rows, ["k"], "v", {"p50": 0.5}).collect()}
    assert {k: r["n"] for k, r in got.items()} == {None: 20, "k0": 20, "k1": 20}
    assert got[None]["p50"] == 286.0
    stats = {r["k"]: r["mean_size"] for r in metrics.batch_size_stats(rows, ["k"], "v").collect()}
    assert stats[None] == 286.0
    assert {r["k"] for r in metrics.queue_wait_stats(rows, ["k"], "v").collect()} == {None, "k0", "k1"}


def test_locality(spark):
    log = spark.createDataFrame([(0, None, "p"), (1, "w", None), (2, None, "p"), (3, "w", None), (4, None, None)],
                                "seq long, worker_id string, prefix_hash string")
    hits = locality.first_touch(log, ["worker_id", "prefix_hash"]).orderBy("seq")
    assert [r["hit"] for r in hits.collect()] == [False, False, True, True, False]
    near = locality.lru_hits(log, 1).orderBy("seq").collect()
    assert [(r["hit"], r["distance"]) for r in near] == [
        (False, None), (False, None), (True, 0), (True, 0), (False, None)]
    batches = log.withColumn("batch_no", F.col("seq"))
    for capacity in (None, 5):
        got = locality.batch_hits(batches, capacity, key="prefix_hash", order=["seq"]).orderBy("seq").collect()
        assert [r["hit"] for r in got] == [False, False, True, True, False]


def test_placement_keeps_null_windows(spark):
    fleet = spark.createDataFrame([(f"w{i}", ["m"]) for i in range(4)], "worker_id string, models array<string>")
    data = [(i, f"p{i % 7}", None if i % 40 == 0 else i // 100) for i in range(400)]
    log = spark.createDataFrame(data, "seq long, key string, w long")
    got = placement.place(log, "key", fleet, [1.25, 0.6], F.col("w")).collect()
    assert sorted(r["seq"] for r in got if r["cap_factor"] == 1.25) == list(range(400))
    assert len(got) == 800 and sum(r["win"] is None for r in got) == 20
    facts = log.selectExpr("seq", "key", "w", "1D AS total_ms", "1D AS queue_wait_ms", "1D AS busy_ms",
                           "seq AS enqueue_us", "seq + 1 AS completed_us")
    rows = sweep.policy_rows(facts, "key", fleet, F.col("w"), (0.6,))
    assert rows.groupBy("policy").count().where("count = 400").count() == 2
    assert rows.where("worker_id IS NULL").count() > 0 and rows.where("worker_id IS NULL AND hit").count() == 0
    both = metrics.policy_summary(rows, 4).collect()
    assert {r["n"] for r in both} == {400}


def test_short_prompts_are_paths(spark):
    served = spark.createDataFrame([(0, "w", "x", ["a"]), (1, "w", "y", ["a"]), (2, "w", "z", [])],
                                   "seq long, worker_id string, path_id string, path array<string>")
    assert [r["refcount"] for r in locality.prefix_trie(served).collect()] == [2]
    assert {r["path_id"] for r in locality.retained_paths(served, 2).collect()} == {"y", "z"}


def test_slow_rates_refill():
    rate = steps.Rate.of(1e-7, 3)
    assert Fraction(rate.refill, rate.burst) > 0
    assert steps.take_token(0, 10 ** 13 + 1, rate)[0]
    with pytest.raises(ValueError):
        steps.Rate.of(1.0, 10 ** 13)


def test_percentiles_of_hot_narrow_and_tied_values(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    groups = {"hot": 100 + rng.random(30_000), "tied": rng.integers(0, 3, 5000).astype(float),
              "one": np.array([7.5]), "two": np.array([1.0, 2.0]), "wide": rng.normal(size=3000) * 1e6}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    for accuracy, bracket_values in ((10_000, 1_000_000), (100, 1_000_000), (10, 20), (4, 2000)):
        got = {r["k"]: r for r in exact_percentiles(df, ["k"], "x", shares, accuracy, bracket_values).collect()}
        assert set(got) == set(groups)
        for k, xs in groups.items():
            assert got[k]["n"] == len(xs)
            for name, p in shares.items():
                assert got[k][name] == pytest.approx(np.quantile(xs, p), rel=1e-12)
    whole = exact_percentiles(df, [], "x", {"p50": 0.5}).collect()
    assert whole[0]["p50"] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))
