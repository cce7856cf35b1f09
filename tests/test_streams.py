"""Streams fed slice by slice agree with their batch twins."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from servelog.operators import stateful
from servelog.streaming import stateful as streams
from servelog.streaming.run import arrival_slices, replay

S = 1_000_000


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(4)
    t, rows = 0, []
    for i in range(400):
        t += rng.randrange(0, 8 * S)
        rows.append((i, "hot" if i % 3 == 0 else f"k{i % 5}", t, f"r{i}",
                     "high" if i % 9 == 0 else "default"))
    df = spark.createDataFrame(rows, "seq long, key string, ts_us long, request_id string, priority string")
    return df.withColumn("ts", F.timestamp_micros("ts_us")).cache()


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_token_bucket(spark, log):
    got = replay([log], arrival_slices(log, "seq", 3),
                 lambda s: streams.stream_token_bucket(s, "key", 0.1, 3.0), "t-bucket")
    want = stateful.token_bucket(log.drop("ts"), "key", 0.1, 3.0, fold_rows=40)
    cols = ("seq", "allowed", "retry_after_s")
    assert _rows(got, *cols) == _rows(want, *cols)


def test_idempotent(spark, log):
    got = replay([log], arrival_slices(log, "seq", 3),
                 lambda s: streams.stream_idempotent(s, "key", 60 * S), "t-idem")
    want = stateful.idempotent(log.drop("ts"), "key", 60 * S)
    cols = ("seq", "original_id", "duplicate")
    assert _rows(got, *cols) == _rows(want, *cols)


def test_batches_and_cap(spark, log):
    budgets = {"high": 5000.0, "default": 40_000.0}
    plan = lambda s: streams.stream_batches(s, "key", 4, budgets)
    got = replay([log], arrival_slices(log, "seq", 3), plan, "t-batch")
    want = stateful.size_or_deadline_batches(log.drop("ts"), "key", 4, budgets)
    end = log.agg(F.max("ts_us")).first()[0]
    closed = want.where(F.col("closed_us") <= end)
    cols = ("key", "seq", "trigger", "closed_us", "slot")
    have, all_closed = _rows(got, *cols), _rows(closed, *cols)
    assert have == all_closed
    capped = replay([log], arrival_slices(log, "seq", 2),
                    lambda s: streams.stream_batches(s, "key", 4, budgets, cap=2), "t-cap")
    sizes = capped.groupBy("key", "first_seq", "closed_us").count().agg(F.max("count")).first()[0]
    assert sizes <= 2


def test_job_lives_expire_and_begin_anew(spark):
    rng = random.Random(8)
    rows = sorted((rng.randrange(4000) * S + 10 ** 12, i, f"j{i % 6}", f"s{i % 7}") for i in range(300))
    df = spark.createDataFrame([(i, j, t, s) for i, (t, _, j, s) in enumerate(rows)],
                               "seq long, job_id string, ts_us long, status string")
    df = df.withColumn("ts", F.timestamp_micros("ts_us"))
    for ttl in (200 * S, 10 ** 6 * S):
        got = replay([df], arrival_slices(df, "seq", 4), lambda s: streams.stream_job_state(s, ttl), "t-jobs", "update")
        assert got.columns == ["job_id", "created_us", "updated_us", "status"]
        last = got.groupBy("job_id").agg(F.max(F.struct("updated_us", "created_us", "status")).alias("l")).select(
            "job_id", "l.created_us", "l.updated_us", "l.status")
        want = stateful.job_state(df.drop("ts"), F.lit(0), ttl)
        assert _rows(last, *got.columns) == _rows(want, *got.columns)


def test_tokens_in_any_order(spark):
    base = 10 ** 15
    parts = [
        [("a", 0, "a", False), ("a", 3, "late", False), ("b", 2, "END", True), ("c", 0, "x", False)],
        [("a", 1, "b", False), ("a", 2, "END", True), ("b", 1, "2", False), ("b", 0, "1", False)],
        [("b", 5, "after", False), ("d", 0, "never final", False)],
    ]
    rows = [(j, q, base + q * S, t, f, n) for n, part in enumerate(parts) for j, q, t, f in part]
    rows.append(("mark", 0, base + 10 ** 4 * S, "", False, 2))
    df = spark.createDataFrame(rows, "job_id string, seq long, ts_us long, token string, final boolean, n int")
    df = df.withColumn("ts", F.timestamp_micros("ts_us"))
    got = replay([df], [F.col("n") == k for k in range(3)], lambda s: streams.stream_tokens(s, delay="1 minute"), "t-tok")
    assert _rows(got, "job_id", "text", "n_tokens") == [("a", "ab", 2), ("b", "12", 2)]
    want = stateful.assemble_tokens(df.where("job_id IN ('a', 'b')").drop("ts")).where("complete")
    assert _rows(got, "job_id", "text", "n_tokens") == _rows(want, "job_id", "text", "n_tokens")


def test_state_is_called_per_bucket_not_per_key(spark):
    """Thousands of keys, long and null ones too, meet as many calls as there are buckets at most."""
    rows = [(i, None if i % 1000 == 7 else i % 3000 + 2 ** 60, i * S + 10 ** 12, f"r{i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "seq long, key long, ts_us long, request_id string")
    df = df.withColumn("ts", F.timestamp_micros("ts_us"))
    got = replay([df], arrival_slices(df, "seq", 2), lambda s: streams.stream_idempotent(s, "key", 10 ** 6 * S), "t-many")
    want = stateful.idempotent(df.drop("ts"), "key", 10 ** 6 * S)
    cols = ("seq", "original_id", "duplicate")
    assert dict(got.dtypes)["key"] == "bigint" and _rows(got, *cols) == _rows(want, *cols)
    assert got.where("key IS NULL").count() == 6 and got.agg(F.max("key")).first()[0] == 2 ** 60 + 2999

    calls = []
    one = streams._JobState("job", S)

    class Handle:
        def getValueState(self, *a):
            return self

        def exists(self):
            return False

        def update(self, value):
            calls.append("update")

        def registerTimer(self, ms):
            calls.append("timer")

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    one.init(Handle())
    chunk = pd.DataFrame({"job": [f"j{i}" for i in range(500)], "ts_us": range(500), "seq": range(500), "status": "s"})
    (out,) = one.handleInputRows((0,), iter([chunk]), Times())
    assert len(out) == 500 and calls == ["update", "timer"]


def test_unknown_priorities_wait_longest(spark):
    rows = [(0, "m", 10 * S, "odd"), (1, "m", 11 * S, None), (2, "m", 70 * S, "high"), (3, "m", 500 * S, "high")]
    df = spark.createDataFrame(rows, "seq long, key string, ts_us long, priority string")
    budgets = {"high": 5000.0, "default": 40_000.0}
    want = stateful.size_or_deadline_batches(df, "key", 4, budgets).orderBy("seq").collect()
    assert [r["closed_us"] for r in want] == [50 * S, 50 * S, 75 * S, 505 * S]
    stream = df.withColumn("ts", F.timestamp_micros("ts_us"))
    got = replay([stream], arrival_slices(stream, "seq", 2),
                 lambda s: streams.stream_batches(s, "key", 4, budgets), "t-odd").orderBy("seq").collect()
    assert [(r["seq"], r["closed_us"]) for r in got] == [(0, 50 * S), (1, 50 * S), (2, 75 * S)]


def test_full_buckets_are_forgotten(spark):
    """Keys that fall silent leave the state; a key that returns finds a full bucket, as in batch."""
    from servelog.streaming.run import _run
    from servelog.session import scratch_path
    rows = [(i, f"k{i}", (1 + i) * S) for i in range(40)] + [(40 + i, "k3", (200 + i) * S) for i in range(4)]
    df = spark.createDataFrame(rows + [(90, "last", 10_000 * S), (91, "last", 10_001 * S)], "seq long, key string, ts_us long")
    got = replay([df], [F.col("seq") < 44, F.col("seq") == 90, F.col("seq") == 91],
                 lambda s: streams.stream_token_bucket(s, "key", 0.1, 3.0), "t-forget")
    cols = ("key", "seq", "allowed", "retry_after_s")
    assert _rows(got, *cols) == _rows(stateful.token_bucket(df, "key", 0.1, 3.0), *cols)
    folder, out, checkpoint = (scratch_path(spark, f"t-state{i}") for i in range(3))
    for part in ("seq < 44", "seq = 90", "seq = 91"):
        df.where(part).write.mode("append").parquet(folder)
        _run(streams.stream_token_bucket(spark.readStream.schema(df.schema).parquet(folder), "key", 0.1, 3.0),
             out, checkpoint, "append")
    state = spark.read.format("statestore").option("stateVarName", "bucket").load(checkpoint)
    assert [r.key["key"] for r in state.select("key").collect()] == ["last"]


def test_metrics_with_batch_size(spark, log):
    from servelog.streaming.metrics import streaming_metrics
    rows = log.select("seq", "ts", F.lit("ok").alias("status"), F.lit(1.0).alias("queue_wait_ms"),
                      F.lit(2.0).alias("total_ms"), (F.col("seq") % 7 + 1).alias("batch_size"))
    got = replay([rows], arrival_slices(rows, "seq", 3), lambda s: streaming_metrics(s, "0 seconds", "10 minutes"), "t-size")
    want = {r.w.start: (r.n, r.m) for r in rows.groupBy(F.window("ts", "10 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("batch_size").alias("m")).collect()}
    have = {r.window_start: (r.n, r.mean_batch_size) for r in got.collect()}
    assert have and all(want[k] == v for k, v in have.items()) and len(have) >= len(want) - 1


def test_quantiles_of_closed_windows(spark, log):
    """Equal to the batch histogram and its quantile, also beyond the last bound and without values."""
    from servelog.operators.metrics import bucket_histogram, histogram_quantile
    from servelog.streaming.metrics import streaming_quantiles
    v = F.when(F.col("seq") % 5 == 0, 20.0).when(F.col("seq") % 7 > 0, F.col("seq") % 40 / 10.0)
    rows = log.select("seq", "ts", (F.col("seq") % 3).alias("k"), v.alias("v")).withColumn(
        "v", F.when(F.col("k") < 2, F.col("v")))
    got = {(r.window_start, r.k): r for r in replay([rows], arrival_slices(rows, "seq", 3), lambda s: streaming_quantiles(
        s, "0 seconds", "v", "10 minutes", by=["k"]), "t-quantiles").collect()}
    hist = bucket_histogram(rows.withColumn("w", F.window("ts", "10 minutes")["start"]), ["w", "k"], "v")
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        want = {(r.w, r.k): r.quantile for r in histogram_quantile(hist, ["w", "k"], q).collect()}
        assert got and all(r[name] == (None if want[key] is None else pytest.approx(want[key])) for key, r in got.items())
    assert any(r.p99 == 10.0 for r in got.values()) and any(r.n == 0 and r.p50 is None for r in got.values())
