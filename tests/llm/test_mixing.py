import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from servelog.llm import mixing, queries
from tests.llm import brute
from tests.oracle import connect, difference

SCHEMA = "doc_id long, text string, source string, n_chars long, size string, target string, nth int"


def table(spark, sizes, seed=1):
    """Documents of random sizes per source, with clashing extra columns."""
    random.seed(seed)
    rows, at = [], 0
    for source, (n, top) in sizes.items():
        for _ in range(n):
            text = " ".join(f"w{at}x{k}" for k in range(random.randint(0, top)))
            rows.append((at, text, source, len(text), "s", "t", 9))
            at += 1
    return spark.createDataFrame(rows, SCHEMA), rows


def test_targets_and_shares(spark):
    docs, rows = table(spark, {"b": (40, 300), None: (30, 500), "a": (3, 20), "Z": (60, 90), "é": (0, 1)})
    got = mixing.mix(docs, block_words=4).collect()
    order = ["Z", "a", "b", None]
    sizes = [sum(len(r[1].split()) for r in rows if r[2] == s) for s in order]
    want = dict(zip(order, brute.water_fill(sizes, [3, 1, 2, 3])))
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert r.source_size == sizes[order.index(r.source)]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 8
    again = mixing.mix(docs.repartition(7), block_words=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shelves_of_shards(spark):
    """Quotas pass from sources over shelves to shards; no bound on shards."""
    docs, rows = table(spark, {"a": (300, 40), "b": (20, 300), None: (9, 30)})
    got = mixing.mix(docs, block_words=4, shard_words=60, shelf_shards=5).collect()
    sizes = [sum(len(r[1].split()) for r in rows if r[2] == s) for s in ("a", "b", None)]
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    # A shard takes twice its words at most, so what its last block has over is lost.
    for source, target, size in zip(("a", "b", None), brute.water_fill(sizes, [3, 1, 2]), sizes):
        assert abs(taken[source] - target) <= 4 + 4 * -(-size // 60)


def test_repeated_ids_of_one_size(spark):
    """Three texts of one doc_id and size: reruns from other files take the same words of each."""
    rows = [(1, f"{x} " * 40, "a", 80, "", "", 1) for x in "xyz"] + [
        (k, "w " * 30, "b", 60, "", "", 1) for k in range(2, 12)]
    runs = [sorted((r.doc_id, r.text) for r in mixing.mixed_texts(spark.createDataFrame(order, SCHEMA)).collect())
            for order in (rows, rows[::-1])]
    assert runs[0] == runs[1] and {i for i, _ in runs[0]} >= {1}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=9), st.integers(0, 60))
def test_sainte_lague(spark, votes, seats):
    parties = spark.createDataFrame([("g", i, v, seats) for i, v in enumerate(votes)],
                                    "g string, i long, v long, seats long")
    got = mixing.apportion(parties, ["g"], "v", "seats", "i", "won").collect()
    assert [r.won for r in sorted(got, key=lambda r: r.i)] == brute.sainte_lague(votes, seats)


def test_mixed_texts_hold_what_was_taken(spark):
    docs, rows = table(spark, {"a": (30, 60), "b": (12, 200), "c": (20, 20)})
    docs = docs.union(docs.where("doc_id = 3"))  # a repeated row
    shares = {}
    for r in mixing.mix(docs).collect():
        shares[r.doc_id] = shares.get(r.doc_id, 0) + r.taken
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    words, text_of = defaultdict(int), {r[0]: r[1] for r in rows}
    for r in out.collect():
        assert r.text in text_of[r.doc_id] and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {k: v for k, v in shares.items() if v}


def test_nulls_and_empty(spark):
    rows = [(None, None, None, 0, "", "", 1), (1, "", "a", 0, "", "", 1), (1, "x y z", None, 5, "", "", 1)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.size for r in got) == [0, 0, 3] and all(r.taken <= 2 * r.size for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame(rows[:2], SCHEMA)).collect()] == [0, 0]


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("op10_mixing", "op4_minhash_dedup", "op5_vector_dedup"):
        assert difference(queries.QUERIES[name](spark, sf), connect(sf), queries.SQL[name]) is None
