import math
from hashlib import md5
from collections import Counter

import pytest
from pyspark.sql import functions as F

from servelog.operators import placement, ring


@pytest.fixture(scope="module")
def log(spark):
    """Two windows of 300 rows; one key holds a third of them."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 23))
    return spark.range(600).select(F.col("id").alias("seq"), key.alias("key"),
                                   F.floor(F.col("id") / 300).alias("w"))


@pytest.fixture(scope="module")
def fleet(spark):
    return spark.createDataFrame([(f"w{i}", i) for i in range(4)], "worker_id string, load int")


def _place(log, fleet, caps, **options):
    return placement.place(log, "key", fleet, caps, F.col("w"), **options).collect()


def _sequential(rows, walks, cap, n):
    """Rounds by hand: round r offers leftovers, oldest first, their r-th choice."""
    left, load, out = sorted(rows), Counter(), {}
    for rank in range(n):
        rest = []
        for seq, key in left:
            worker = walks[key][rank]
            if load[worker] < cap:
                load[worker] += 1
                out[seq] = worker
            else:
                rest.append((seq, key))
        left = rest
    return out


def test_unbounded_cap_is_the_owner(spark, log, fleet):
    owner = {r["seq"]: r["worker_id"]
             for r in ring.ring_owner(log, ring.ring_table(fleet)).collect()}
    assert {r["seq"]: r["worker_id"] for r in _place(log, fleet, [placement.UNBOUNDED])} == owner


def test_rounds_equal_a_row_by_row_walk_whatever_the_slices(spark, log, fleet):
    keys = log.select("key").distinct()
    walks = {}
    for r in ring.ring_preference(keys, ring.ring_table(fleet)).orderBy("rank").collect():
        walks.setdefault(r["key"], []).append(r["worker_id"])
    rows = [(r["w"], r["seq"], r["key"]) for r in log.collect()]
    caps = [1.0, 1.1, 1.5, 0.5]
    for width in (1_000_000, 7):
        got = _place(log, fleet, caps, slice_rows=width)
        assert len(got) == 600 * len(caps)
        for factor in caps:
            for win in (0, 1):
                part = [(s, k) for w, s, k in rows if w == win]
                want = _sequential(part, walks, factor * max(len(part) / 4, 1), 4)
                have = {r["seq"]: r["worker_id"] for r in got
                        if r["cap_factor"] == factor and r["win"] == win and r["worker_id"]}
                assert have == want


def test_load_stays_under_the_cap_and_everything_is_placed(spark, log, fleet):
    got = _place(log, fleet, [1.0, 1.25])
    loads = Counter((r["cap_factor"], r["win"], r["worker_id"]) for r in got)
    assert all(n <= math.ceil(cap * 75) for (cap, _, _), n in loads.items())
    assert all(r["worker_id"] for r in got)


def test_base_load_and_eligibility(spark, log, fleet):
    got = placement.place(log, "key", fleet, [1.0], F.col("w"), eligible=F.col("load") != 2,
                          load=F.col("load") * 20).collect()
    loads = Counter((r["win"], r["worker_id"]) for r in got)
    cap = (300 + 0 + 20 + 60) / 3
    assert {w for _, w in loads} <= {"w0", "w1", "w3"}
    assert loads[0, "w3"] <= math.ceil(cap - 60) and loads[0, "w0"] <= math.ceil(cap)


def test_a_cap_below_one_leaves_rows_unplaced(spark, log, fleet):
    left = placement.backpressure_rows(log, "key", fleet, 0.5, F.col("w")).count()
    assert left == 600 - 2 * 4 * math.ceil(0.5 * 75)


def test_balanced_counts_are_equal(spark, log, fleet):
    got = placement.balanced_assign(log, fleet, F.col("w"), slice_rows=50)
    counts = [r["count"] for r in got.groupBy("win", "worker_id").count().collect()]
    assert counts == [75] * 8


def test_stem_key_prefers_the_deepest_shared_block(spark):
    rows = [(1, 1, "r"), (1, 2, "a"), (1, 3, "x"), (2, 1, "r"), (2, 2, "a"), (2, 3, "y"),
            (3, 1, "r"), (3, 2, "b"), (4, 1, "q")]
    chains = spark.createDataFrame(rows, "seq long, depth int, chain_hash string")
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "short"), (6, None)],
                                  "seq long, text string")
    got = {r["seq"]: (r["stem_key"], r["stem_depth"])
           for r in placement.shared_stem_key(chains, texts, min_support=2).collect()}
    assert got == {1: ("a", 2), 2: ("a", 2), 3: ("r", 1), 4: ("q", 1), 5: (md5(b"short").hexdigest(), 0),
                   6: (md5(b"").hexdigest(), 0)}


def test_rows_go_to_workers_that_hold_their_model(spark):
    fleet = spark.createDataFrame([("w0", ["a", "b"]), ("w1", ["b"]), ("w2", ["b"])],
                                  "worker_id string, models array<string>")
    data = [(i, f"p{i % 5}", "a" if i % 4 == 0 else "b" if i % 4 < 3 else None if i % 8 == 3 else "c") for i in range(160)]
    log = spark.createDataFrame(data, "seq long, key string, model string")
    for cap in (1.0, 1.25, 0.5):
        got = {r["seq"]: r["worker_id"] for r in placement.place(
            log, "key", fleet, [cap], F.lit(0), model="model").collect()}
        assert sorted(got) == list(range(160))
        taken = {}
        for seq, _, model in data:
            taken.setdefault(model, []).append(got[seq])
        assert set(taken[None]) == set(taken["c"]) == {None}
        assert taken["a"].count("w0") == math.ceil(cap * 40) if cap <= 1 else 40
        for w in ("w0", "w1", "w2"):
            assert taken["b"].count(w) <= math.ceil(cap * 80 / 3)
        assert cap < 1 or None not in taken["b"]
