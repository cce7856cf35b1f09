"""What a task holds is bounded by rows and bytes, whatever the table's size."""

import hashlib
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from servelog import session
from servelog.catalog import joins as join_queries
from servelog.catalog import locality as locality_queries
from servelog.catalog import placement as placement_queries
from servelog.functions import keys
from servelog.operators import infer, locality, placement
from servelog.plans import dominance
from servelog.session import cut


def test_slices_of_requests_hold_equal_numbers_of_blocks(spark, monkeypatch):
    paths = spark.range(40).select(
        F.lit("w").alias("worker_id"), F.col("id").alias("seq"),
        F.transform(F.sequence(F.lit(1), F.col("id") % 7 + 5), lambda d: F.concat((F.col("id") % 3).cast("string"), F.lit("-"), d.cast("string"))).alias("path"))
    chains = paths.select("worker_id", "seq", F.posexplode("path").alias("p", "chain_hash")).select(
        "worker_id", "seq", (F.col("p") + 1).alias("depth"), "chain_hash")
    lengths = paths.select("worker_id", "seq", F.size("path").alias("n_blocks"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    want, seen, real = rows(locality.reuse_depth_lru(chains, lengths, 20, slice_=F.lit(0).cast("long"))), [], locality.batch_hits
    monkeypatch.setattr(locality, "SLICE_BLOCKS", 50)
    monkeypatch.setattr(locality, "batch_hits", lambda *a: seen.append(a[-1]) or real(*a))
    assert rows(locality.reuse_depth_lru(chains, lengths, 20)) == want
    sizes = [r["count"] for r in chains.groupBy(seen[0].alias("s")).count().collect()]
    assert len(sizes) > 3 and max(sizes) < 120


def test_slices_of_texts_are_bounded_by_bytes(spark, monkeypatch):
    df, seen, real = spark.range(5003).select(F.col("id").alias("seq"), F.lit("x" * 100).alias("t")), [], infer.sliced_row_number
    monkeypatch.setattr(infer, "SLICE_BYTES", 120_000)
    monkeypatch.setattr(infer, "sliced_row_number", lambda *a: seen.append(a[3]) or real(*a))
    got = infer.batch_infer(df, "t", lambda: lambda texts: (texts, 1.0), 16, order="seq")
    assert got.where("batch_size <> 16").count() == 11
    assert df.groupBy(seen[0].alias("s")).count().agg(F.max("count")).first()[0] < 1500


def test_block_hashes_of_many_texts_in_one_batch(spark):
    texts = [None if i % 50 == 3 else "é😀ab"[i % 4:] * (i % 90) for i in range(3 * keys._TEXTS + 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, t string").coalesce(1)
    got = {r["seq"]: r["p"] for r in df.select("seq", keys.block_path("t", 8).alias("p")).collect()}
    for i, text in enumerate(texts):
        digest, want = "", []
        for at in range(0, len(text or "") // 8 * 8, 8):
            digest = hashlib.md5((digest + text[at:at + 8]).encode()).hexdigest()
            want.append(digest)
        assert got[i] == want


def test_block_hashes_are_evaluated_once(spark, tmp_path):
    text = F.repeat(F.concat(F.lit("t"), (F.col("id") % 5).cast("string")), 100)
    spark.range(60).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang")).write.parquet(
        str(tmp_path / "documents.parquet"))
    for query in (placement_queries.shared_stem_keys, join_queries.longest_prefix_match):
        got = query(spark, str(tmp_path))
        assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert placement_queries.shared_stem_keys(spark, str(tmp_path)).where("stem_depth = 3").count() == 60


def test_blocks_in_python_are_bounded():
    assert dominance.POSITIONS_PER_SLICE <= 100_000


def test_takers_give_a_row_of_the_log_once(spark):
    log = spark.range(500).select(F.col("id").alias("seq"), (F.col("id") % 9).cast("string").alias("key"))
    fleet = spark.createDataFrame([("a",), ("b",), ("c",)], "worker_id string")
    window, caps = F.floor(F.col("seq") / 200).cast("long"), [1.0, 1.5, float("inf")]
    wide = placement.takers(log, "key", fleet, caps, window)
    assert wide.count() == 500 and wide.where(F.size("takes") == 3).count() == 500
    flat = placement.place(log, "key", fleet, caps, window)
    assert flat.columns == ["cap_factor", "win", "seq", "worker_id", "rank"] and flat.count() == 1500


def _bytes_of_shuffles(spark):
    """What shuffles have written to disk that is still there."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()]
    return sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data"))


def test_shuffle_files_of_a_written_table_are_removed(spark):
    df = spark.range(300_000).select(F.md5(F.col("id").cast("string")).alias("h")).repartition(7, "h")
    before = _bytes_of_shuffles(spark)
    kept = cut(df)
    end = time.time() + 10
    while _bytes_of_shuffles(spark) - before > 1_000_000 and time.time() < end:
        time.sleep(0.1)
    assert _bytes_of_shuffles(spark) - before < 1_000_000
    assert kept.count() == 300_000


def test_blocks_under_a_capacity_take_few_bytes(spark, tmp_path, monkeypatch):
    """20,000 blocks of 64 characters: the tables kept on the way hold less than 64 bytes a block."""
    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.md5(F.concat_ws("-", F.col("id") % 90, k))))
    spark.range(200).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang")).write.parquet(
        str(tmp_path / "documents.parquet"))
    paths, real = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda *a: paths.append(real(*a)) or paths[-1])
    got = locality_queries.reuse_depth_lru(spark, str(tmp_path))
    assert got.agg(F.sum("n_blocks")).first()[0] == 20_000
    kept = sum(f.stat().st_size for p in paths for f in Path(p).rglob("*.parquet"))
    assert kept < 64 * 20_000


def _hits_by_replay(rows, capacity):
    """(worker, batch, key) in order -> hit: under ``capacity`` distinct keys since its last access before the batch."""
    hits = []
    for i, (worker, batch, key) in enumerate(rows):
        start = next(k for k, r in enumerate(rows) if r[:2] == (worker, batch))
        at = [k for k in range(start) if rows[k][0] == worker and rows[k][2] == key]
        between = {rows[k][2] for k in range(at[-1] + 1, start) if rows[k][0] == worker} if at else None
        hits.append(at != [] and len(between) < capacity)
    return hits


@pytest.mark.parametrize("hot,width", [(250_000, 100_000), (8, 16), (64, 7)])
def test_batch_hits_with_hot_keys_and_narrow_slices(spark, monkeypatch, hot, width):
    rng = random.Random(hot)
    log, batch = [], 0
    for _ in range(900):
        batch += rng.random() < 0.2
        log.append((rng.choice(["w", "w", "v", None]), batch, rng.choice(["hot", "hot", None, *"abcdefghijklmnop"])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(log)], "seq long, worker_id string, batch_no long, prefix_id string")
    monkeypatch.setattr(locality, "HOT_ACCESSES", hot)
    monkeypatch.setattr(locality, "SAMPLE", 1 if hot < 100 else 64)
    real = locality.distinct_between
    monkeypatch.setattr(locality, "distinct_between", lambda points, asks: real(points, asks, width))
    for capacity in (1, 6):
        got = locality.batch_hits(df, capacity, order=["seq"], slice_=F.floor(F.col("seq") / 100))
        assert [r["hit"] for r in got.orderBy("seq").collect()] == _hits_by_replay(log, capacity)
