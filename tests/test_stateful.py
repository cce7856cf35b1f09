"""Stateful operators: known cases, and slices against a plain sequential fold."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from servelog.functions import steps
from servelog.operators import stateful


def _calls(rate, times, cost=1):
    tokens, last, out = rate.burst, None, []
    for t in times:
        ok, tokens, retry = steps.take_token(tokens, 0 if last is None else t - last, rate)
        last = t
        out.append((ok, retry))
    return out, tokens


S = steps.MICROS


def test_burst_then_reject_then_refill():
    got, _ = _calls(steps.Rate.of(2, 2), [0, 0, 0, S // 2, 10_000 * S, 10_000 * S, 10_000 * S])
    assert [ok for ok, _ in got] == [True, True, False, True, True, True, False]
    assert got[2][1] == 0.5


def test_defaults_costs_and_clock_skew():
    assert steps.Rate.of(5, 0).burst == steps.Rate.of(5, 5).burst
    got, _ = _calls(steps.Rate.of(1, 10, 5), [0, 0, 0])
    assert [ok for ok, _ in got] == [True, True, False] and got[2][1] == 5.0
    got, _ = _calls(steps.Rate.of(1, 1), [10 * S, 0])
    assert [ok for ok, _ in got] == [True, False]
    assert steps.take_token(0, S, steps.Rate.of(0, 1))[2] == float("inf")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4_000_000), max_size=60), st.integers(1, 5), st.integers(1, 3),
       st.sampled_from([1, 2, 1 / 3, 10]))
def test_bucket_transfer_is_the_fold(gaps, burst, cost, rps):
    rate = steps.Rate.of(rps, burst, cost)
    pieces = steps.bucket_transfer(gaps, rate)
    # Marks of one token plus a few odd values.
    for start in {0, rate.burst, rate.burst // 2, rate.burst // 3, rate.cost, rate.cost - 1, 1}:
        start = min(start, rate.burst)
        tokens = start
        for gap in gaps:
            _, tokens, _ = steps.take_token(tokens, gap, rate)
        assert steps.apply_transfer(pieces, start) == tokens


def test_saturated_transfer_stays_small():
    rng = random.Random(1)
    rate = steps.Rate.of(10, 20)
    pieces = steps.bucket_transfer([rng.randrange(90_000) for _ in range(5000)], rate)
    assert len(pieces) <= 25


@pytest.mark.parametrize("rps,burst", [(1.0, 4.0), (1 / 3, 2.0)])
def test_hot_key_in_slices_equals_the_sequential_fold(spark, rps, burst):
    rng = random.Random(5)
    t, rows = 0, []
    for i in range(900):
        t += rng.randrange(0, 1_400_000)
        rows.append((i, "hot" if i % 3 else f"k{i % 4}", t))
    df = spark.createDataFrame(rows, "seq long, key string, ts_us long")
    got = {r["seq"]: (r["allowed"], r["retry_after_s"])
           for r in stateful.token_bucket(df, "key", rps, burst, fold_rows=50).collect()}
    rate = steps.Rate.of(rps, burst)
    for key in {r[1] for r in rows}:
        mine = [(s, ts) for s, k, ts in rows if k == key]
        want, _ = _calls(rate, [ts for _, ts in mine])
        assert [got[s] for s, _ in mine] == want
    assert {a for a, _ in got.values()} == {True, False}


def test_idempotency_window_is_anchored_at_its_first_row(spark):
    rows = [(0, "a", 0), (1, "a", 5), (2, "a", 9), (3, "a", 10), (4, "b", 12), (5, "a", 19), (6, "a", 25)]
    df = spark.createDataFrame([(s, k, t, f"r{s}") for s, k, t in rows],
                               "seq long, k string, ts_us long, request_id string")
    want = {0: ("r0", False), 1: ("r0", True), 2: ("r0", True), 3: ("r3", False),
            4: ("r4", False), 5: ("r3", True), 6: ("r6", False)}
    for rows in (1000, 2, 1):
        got = stateful.idempotent(df, "k", 10, fold_rows=rows).collect()
        assert {r["seq"]: (r["original_id"], r["duplicate"]) for r in got} == want


def _fold_idempotent(rows, ttl):
    opened, out = {}, {}
    for seq, key, ts, rid in sorted(rows, key=lambda r: (r[2], r[0])):
        opened[key], repeat = steps.enter_window(ts, rid, ttl, opened.get(key))
        out.setdefault(seq, []).append((opened[key][1], repeat))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("fold_rows", [10 ** 6, 37, 5])
def test_idempotency_slices_equal_the_sequential_fold(spark, fold_rows):
    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 5 == 0 else f"k{i % 50}", rng.randrange(2000), f"r{i}")
            for i in range(1200)]
    rows += [(7, "hot", 900, "twin-a"), (7, "hot", 900, "twin-b")]  # one key, one seq, one time
    df = spark.createDataFrame(rows, "seq long, k string, ts_us long, request_id string")
    for ttl in (1, 70, 100_000):
        got = {}
        for r in stateful.idempotent(df, "k", ttl, fold_rows=fold_rows).collect():
            got.setdefault(r["seq"], []).append((r["original_id"], r["duplicate"]))
        want = _fold_idempotent(rows, ttl)
        if ttl > 1:  # which twin opens is open only where they open a window
            assert {k: sorted(v) for k, v in got.items()} == want


def test_many_windows_on_one_key(spark):
    n = 100_000
    df = spark.range(n).selectExpr("id AS seq", "'k' AS k", "id * 10 AS ts_us", "concat('r', id) AS request_id")
    got = stateful.idempotent(df, "k", 15, fold_rows=4096)
    assert got.where("duplicate = (seq % 2 = 0)").count() == 0


def _batched(spark, rows, max_batch=16, fold_rows=1000, budgets=None):
    df = spark.createDataFrame([(i, "m", int(t * 1000), p) for i, (t, p) in enumerate(rows)],
                               "seq long, model string, ts_us long, priority string")
    got = stateful.size_or_deadline_batches(df, "model", max_batch, budgets or {"high": 5.0, "default": 50.0},
                                            fold_rows=fold_rows)
    return {r["seq"]: r for r in got.collect()}


def test_full_batch_closes_at_once(spark):
    got = _batched(spark, [(0, "default")] * 16 + [(1, "default")])
    assert {got[i]["trigger"] for i in range(16)} == {"full"} and got[0]["closed_us"] == 0
    assert got[16]["trigger"] == "overdue" and got[16]["closed_us"] == 51_000


def test_overdue_high_item_flushes_and_leads(spark):
    got = _batched(spark, [(0, "default"), (10, "high"), (12, "default"), (30, "default")])
    assert [got[i]["batch_no"] for i in range(4)] == [1, 1, 1, 4]
    assert got[1]["slot"] == 1 and got[0]["slot"] == 2 and got[0]["closed_us"] == 15_000


def test_old_default_item_is_not_starved(spark):
    rows = [(0, "default")] + [(t, "high") for t in range(3, 60, 4)]
    got = _batched(spark, rows, max_batch=64)
    assert got[0]["closed_us"] <= 50_000


def test_batches_do_not_depend_on_slices(spark):
    rng = random.Random(2)
    t, rows = 0.0, []
    for _ in range(1500):
        t += rng.choice([0, 0.2, 0.5, 2, 7])
        rows.append((t, "high" if rng.random() < 0.1 else "default"))
    whole = _batched(spark, rows, 8, 10_000)
    assert {r["trigger"] for r in whole.values()} == {"full", "overdue"}
    for width in (8, 37, 200):
        cut = _batched(spark, rows, 8, width)
        assert {s: tuple(r) for s, r in cut.items()} == {s: tuple(r) for s, r in whole.items()}


def test_liveness_splits_at_the_ttl(spark):
    rows = [("a", t) for t in (0, 10, 14, 29, 44, 60)] + [("b", 5)]
    df = spark.createDataFrame(rows, "worker_id string, ts_us long")
    lives = stateful.worker_liveness(df, 15)
    got = sorted(tuple(r) for r in lives.collect())
    assert got == [("a", 0, 29, 3), ("a", 29, 44, 1), ("a", 44, 59, 1), ("a", 60, 75, 1), ("b", 5, 20, 1)]
    assert [r[0] for r in stateful.active_workers(lives, 59).collect()] == []


def test_tokens_stop_at_the_first_final_row(spark):
    rows = [("j", 0, "a", False), ("j", 1, "b", False), ("j", 2, "END", True), ("j", 3, "late", False),
            ("open", 5, "x", False), ("empty", 0, "E", True)]
    df = spark.createDataFrame(rows, "job_id string, seq long, token string, final boolean")
    got = {r["job_id"]: tuple(r)[1:] for r in stateful.assemble_tokens(df, slice_rows=2).collect()}
    assert got == {"j": ("ab", 2, True), "open": ("x", 1, False), "empty": ("", 0, True)}


def test_job_state_expires(spark):
    rows = [("a", 0, 0, "queued"), ("a", 1, 50, "done"), ("b", 2, 90, "queued")]
    df = spark.createDataFrame(rows, "job_id string, seq long, ts_us long, status string")
    got = stateful.job_state(df, F.lit(100), ttl_us=100).collect()
    assert [(r["job_id"], r["status"]) for r in got] == [("b", "queued")]
