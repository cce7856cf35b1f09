from bisect import bisect_right

from pyspark.sql import functions as F

from servelog.functions.keys import ring_position
from servelog.operators import ring


def _fleet(spark, n):
    return spark.range(n).select(F.concat(F.lit("w"), F.col("id")).alias("worker_id"))


def _keys(spark, n, stem="prefix-"):
    return spark.range(n).select(F.concat(F.lit(stem), F.col("id")).alias("key"))


def test_owner_is_first_position_after_the_key(spark):
    table = ring.ring_table(_fleet(spark, 5), 40)
    nodes = sorted((r["pos"], r["worker_id"]) for r in table.collect())
    at = [p for p, _ in nodes]
    rows = ring.ring_owner(_keys(spark, 2000), table).withColumn("pos", ring_position("key")).collect()
    assert len(rows) == 2000
    for r in rows:
        assert r["worker_id"] == nodes[bisect_right(at, r["pos"]) % len(nodes)][1]


def test_key_on_a_position_goes_to_the_next_one(spark):
    nodes = spark.createDataFrame([("0" * 15 + "1", "a"), ("8" + "0" * 15, "b")], "pos string, worker_id string")
    arcs = {(r["lo"], r["hi"]): r["worker_id"] for r in ring.ring_arcs(nodes).collect()}
    assert arcs == {("", "0" * 15 + "1"): "a", ("0" * 15 + "1", "8" + "0" * 15): "b",
                    ("8" + "0" * 15, "g"): "a"}


def test_preference_visits_every_worker_once_owner_first(spark):
    table = ring.ring_table(_fleet(spark, 6), 20)
    keys = _keys(spark, 200)
    owner = {r["key"]: r["worker_id"] for r in ring.ring_owner(keys, table).collect()}
    walks = {}
    for r in ring.ring_preference(keys, table).collect():
        walks.setdefault(r["key"], {})[r["rank"]] = r["worker_id"]
    nodes = sorted((r["pos"], r["worker_id"]) for r in table.collect())
    pos = {r["key"]: r["p"] for r in keys.withColumn("p", ring_position("key")).collect()}
    for key, walk in walks.items():
        start = bisect_right([p for p, _ in nodes], pos[key])
        order = list(dict.fromkeys(nodes[(start + i) % len(nodes)][1] for i in range(len(nodes))))
        assert [walk[r] for r in sorted(walk)] == order
        assert walk[1] == owner[key]


def test_single_worker_ring(spark):
    table = ring.ring_table(_fleet(spark, 1), 3)
    assert {r["worker_id"] for r in ring.ring_owner(_keys(spark, 50), table).collect()} == {"w0"}


def test_growth_moves_few_keys_and_only_onto_the_new_worker(spark):
    before, after = (ring.ring_table(_fleet(spark, n)) for n in (8, 9))
    grow = ring.rebalance_report(_keys(spark, 5000), before, after).first()
    assert 0.04 < grow["fraction_moved"] < 0.25 and grow["n_unneeded"] == 0
    shrink = ring.rebalance_report(_keys(spark, 5000), after, before).first()
    assert shrink["n_moved"] == grow["n_moved"] and shrink["n_unneeded"] == 0


def test_keys_spread_evenly(spark):
    table = ring.ring_table(_fleet(spark, 4))
    counts = [r["count"] for r in ring.ring_owner(_keys(spark, 20000, "k-"), table)
              .groupBy("worker_id").count().collect()]
    shares = [c / 20000 for c in counts]
    assert len(shares) == 4 and max(shares) < 0.35 and min(shares) > 0.15


def test_large_rings_are_not_broadcast(spark, monkeypatch):
    """The same arcs, owners and report; more buckets; no broadcast of a ring or its workers."""
    before, after = (ring.ring_table(_fleet(spark, n)) for n in (60, 61))
    rows = lambda df, *by: sorted(map(tuple, df.select(*by).collect()))
    arcs = ("arc", "lo", "hi", "worker_id")
    small = (rows(ring.ring_arcs(before), *arcs), rows(ring.ring_owner(_keys(spark, 3000), before), "key", "worker_id"),
             ring.rebalance_report(_keys(spark, 3000), before, after).first())
    monkeypatch.setattr(ring, "_BROADCAST_ROWS", 1000)
    large = (rows(ring.ring_arcs(before, 9600), *arcs), rows(ring.ring_owner(_keys(spark, 3000), before), "key", "worker_id"),
             ring.rebalance_report(_keys(spark, 3000), before, after).first())
    assert small == large
    plan = ring.rebalance_report(_keys(spark, 3000), before, after)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert ring._digits(1000) == 3 and 16 ** ring._digits(9_600_000) * 16 >= 9_600_000
