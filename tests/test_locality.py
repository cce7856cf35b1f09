import random

import pytest
from pyspark.sql import functions as F

from servelog.operators import joins, locality
from servelog.functions.keys import block_chain, block_path, prefix_key


def _batches(spark, *batches):
    rows, seq = [], 0
    for number, batch in enumerate(batches):
        for prefix in batch:
            rows.append((seq, number, "w", prefix))
            seq += 1
    return spark.createDataFrame(rows, "seq long, batch_no long, worker_id string, prefix_id string")


def _summary(df):
    return [(r["size"], r["hits"], r["distinct_missed"]) for r in df.orderBy("batch_no").collect()]


def test_residency_is_judged_at_batch_start(spark):
    df = _batches(spark, ["p1", "p2"], ["p1", "p2"], ["s", "s", "p1"])
    assert _summary(locality.batch_locality(df)) == [(2, 0, 2), (2, 2, 0), (3, 1, 1)]


def test_lru_eviction_order_with_a_capacity(spark):
    df = _batches(spark, ["A"], ["B"], ["A"], ["C"], ["A"], ["B"])
    got = locality.batch_locality(df, 2, order=["seq"], slice_=F.floor(F.col("seq") / 2))
    assert [h for _, h, _ in _summary(got)] == [0, 0, 1, 0, 1, 0]


def test_a_repeat_inside_one_batch_is_no_hit_even_with_capacity(spark):
    df = _batches(spark, ["A", "B", "A"], ["A"])
    got = locality.batch_locality(df, 2, order=["seq"], slice_=F.lit(0).cast("long"))
    assert _summary(got) == [(3, 0, 2), (1, 1, 0)]


def test_latency_law(spark):
    df = spark.createDataFrame([(1, 0), (4, 0), (16, 2), (0, 0)], "size long, distinct_missed long")
    got = locality.batch_cost(df, workers=4, slots=4).collect()
    assert [r["latency_ms"] for r in got] == [25.5, 48.0, 138.0 + 320.0, 0.0]
    assert got[0]["capacity_rps"] == 16 * 1000 / 185.5


def _served(spark, *rows):
    """(worker, letters): a path of cumulative letters per row."""
    data = [(i, w, p, [p[:d + 1] for d in range(len(p))]) for i, (w, p) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, worker_id string, path_id string, path array<string>")


def _owners(trie):
    return {(r["chain_hash"], r["worker_id"]): r["refcount"] for r in trie.collect()}


def test_trie_counts_distinct_paths_and_refreshes(spark):
    trie = locality.prefix_trie(_served(spark, ("w", "ab"), ("w", "ac"), ("w", "ab"), ("v", "a")))
    assert _owners(trie) == {("a", "w"): 2, ("ab", "w"): 1, ("ac", "w"): 1, ("a", "v"): 1}
    assert {r["parent_hash"] for r in trie.where("depth = 2").collect()} == {"a"}
    assert trie.where("chain_hash = 'a' AND worker_id = 'w'").first()["last_seq"] == 2


def test_eviction_keeps_nodes_of_longer_retained_paths(spark):
    trie = locality.prefix_trie(_served(spark, ("w", "ab"), ("w", "abc"), ("w", "x")), capacity=2)
    assert _owners(trie) == {("a", "w"): 1, ("ab", "w"): 1, ("abc", "w"): 1, ("x", "w"): 1}
    trie = locality.prefix_trie(_served(spark, ("w", "a"), ("w", "b"), ("w", "a"), ("w", "c")), capacity=2)
    assert set(_owners(trie)) == {("a", "w"), ("c", "w")}


def _match(spark, asks, served, **options):
    chains = spark.createDataFrame(
        [(i, d + 1, p[:d + 1]) for i, p in enumerate(asks) for d in range(len(p))],
        "seq long, depth int, chain_hash string")
    trie = locality.prefix_trie(served)
    got = joins.longest_prefix_match(chains, trie, **options).collect()
    return {r["seq"]: (r["worker_id"], r["matched_blocks"]) for r in got}


def test_longest_match_partial_credit_and_ties(spark):
    served = _served(spark, ("v", "abx"), ("w", "abc"), ("u", "d"))
    assert _match(spark, ["abcd", "abz", "q", "d"], served) == {0: ("w", 3), 1: ("w", 2), 3: ("u", 1)}


def test_match_skips_ineligible_workers(spark):
    served = _served(spark, ("v", "ab"), ("w", "abc"))
    fleet = spark.createDataFrame([("v", 1), ("w", 9)], "worker_id string, inflight int")
    got = _match(spark, ["abc"], served, eligible=fleet, is_eligible=F.col("inflight") < 5)
    assert got == {0: ("v", 2)}


def test_reuse_depth_counts_leading_blocks(spark):
    served = _served(spark, ("w", "abc"), ("w", "abd"), ("v", "abc"), ("w", ""))
    chains = served.select("worker_id", "seq", F.explode("path").alias("chain_hash"))
    lengths = served.select("worker_id", "seq", F.size("path").alias("n_blocks"))
    got = {r["seq"]: (r["reused"], r["reuse_fraction"])
           for r in locality.reuse_depth(chains, lengths).collect()}
    assert got == {0: (0, 0.0), 1: (2, 2 / 3), 2: (0, 0.0), 3: (0, 0.0)}


def test_block_chain_equality_means_equal_leading_blocks(spark):
    text = "x" * 64 + "é😀" * 32 + "tail"
    df = spark.createDataFrame([(1, text), (2, text[:128] + "other"), (3, "y" + text), (4, "short"), (5, None)],
                               "seq long, text string")
    paths = {r["seq"]: r["p"] for r in df.select("seq", block_path("text").alias("p")).collect()}
    assert len(paths[1]) == 2 and paths[1] == paths[2] and paths[4] == [] and paths[5] == []
    assert not set(paths[1]) & set(paths[3])
    assert block_chain(df, "text").count() == 6


def test_prefix_key_ignores_the_suffix(spark):
    df = spark.createDataFrame([("a" * 512 + "1",), ("a" * 512 + "2",), ("b" * 512,)], "t string")
    assert df.select(prefix_key("t")).distinct().count() == 2


def _replay_blocks(rows, capacity):
    """(worker, letters) -> leading blocks resident under one list of recent blocks per worker."""
    kept, out = {}, []
    for worker, letters in rows:
        recent, blocks = kept.setdefault(worker, []), [letters[:d + 1] for d in range(len(letters))]
        held = [b in recent[-capacity:] for b in blocks]
        out.append(held.index(False) if False in held else len(held))
        for b in blocks:
            if b in recent:
                recent.remove(b)
            recent.append(b)
        del recent[:-capacity]
    return out


@pytest.mark.parametrize("capacity", [1, 3, 6, 50])
def test_reuse_depth_under_a_block_capacity(spark, capacity):
    rng = random.Random(capacity)
    rows = [(rng.choice(["w", "v", None]), "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))) for _ in range(150)]
    served = _served(spark, *rows)
    chains = served.select("worker_id", "seq", F.posexplode("path").alias("pos", "chain_hash")).select(
        "worker_id", "seq", (F.col("pos") + 1).alias("depth"), "chain_hash")
    lengths = served.select("worker_id", "seq", F.size("path").alias("n_blocks"))
    got = locality.reuse_depth_lru(chains, lengths, capacity).orderBy("seq").collect()
    assert [r["reused"] for r in got] == _replay_blocks(rows, capacity)
