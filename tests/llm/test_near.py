"""Near-duplicate documents and vectors."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from servelog.llm import chosen_path, pigeonhole
from servelog.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id long, text string, cls string, node string, n string"


def family(seed, words, copies, edits):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        new = list(base)
        for _ in range(draw.randint(0, edits)):
            new[draw.randrange(words)] = f"e{draw.randrange(10**6)}"
        out.append(" ".join(new))
    return out


def corpus():
    texts = []
    for seed, (words, copies, edits) in enumerate([(60, 40, 3), (200, 25, 8), (7, 10, 1), (30, 60, 6), (400, 12, 16)]):
        texts += family(seed, words, copies, edits)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} {' '.join(f'u{i}x{k}' for k in range(40))}" for i in range(40)]
    texts += ["one", "ONE", "one two", "", "  \n", "a b c d", "A b c D", "a b c d e", "x" * 5000] * 2
    random.Random(1).shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("leaf", [2048, 5])
def test_documents(spark, leaf):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "c", "n", "1") for i, t in texts.items()], SCHEMA)
    got = chosen_path.near_duplicates(docs, leaf=leaf).collect()
    want = brute.near_documents(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = chosen_path.keep_one(docs, leaf=leaf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_odd_documents(spark):
    rows = [(1, None), (None, None), (None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"),
            (7, "other text with its own words here"), (3, ""), (None, "lonely words without any id at all")]
    docs = spark.createDataFrame([(*r, "c", "n", "1") for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in
                  chosen_path.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (None, 0, None, True), (None, 3, 7, False), (7, 3, 7, True),
                          (7, 3, 7, True), (7, 3, 7, True), (3, 0, 3, True), (None, 3, None, True)], key=str)
    kept = chosen_path.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 7, 7]
    assert {r.text for r in kept if r.doc_id == 7} == {"a b c d e f g", "other text with its own words here"}
    assert len([r for r in kept if r.doc_id is None]) == 2  # without words, and the lonely one
    empty = docs.where("false")
    assert chosen_path.near_duplicates(empty).count() == 0 and chosen_path.keep_one(empty).count() == 0
    with pytest.raises(ValueError):
        chosen_path.near_duplicates(docs, percent=50)


def test_components(spark):
    random.seed(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, b) for b in range(101, 160)] + [(7, 7), (200, 201)]
    edges += [(random.randint(300, 400), random.randint(300, 400)) for _ in range(60)]
    frame = spark.createDataFrame(edges + edges[:9], "a long, b long")
    want = brute.components({x for e in edges for x in e}, edges)
    got = {r.node: r.root for r in components(frame, "a", "b").collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def vectors(dims, seed):
    draw = np.random.default_rng(seed)
    rows = [(v, lab) for lab in (1, 2) for v in draw.normal(size=(60, dims))]
    for spread in (0.01, 0.02, 0.026):
        centre = draw.normal(size=dims)
        rows += [(centre + draw.normal(size=dims) * spread * np.sqrt(2), 1) for _ in range(70)]
    rows += [(rows[0][0], 1)] * 30 + [(rows[0][0] * 2, 1), (rows[0][0], 2), (rows[0][0], None), (rows[1][0], None)]
    return rows


@pytest.mark.parametrize("kind,dims,tile", [("float", 64, 1024), ("double", 24, 40), ("double", 3, 16)])
def test_vectors(spark, kind, dims, tile):
    rows = [([float(np.float32(x)) for x in v] if kind == "float" else v.tolist(), lab) for v, lab in vectors(dims, dims)]
    odd = [None, [], [0.0] * dims, [None] + [1.0] * (dims - 1), [float("nan")] * dims, [float("inf")] * dims,
           [-0.0] * dims, [1.0]]
    rows += [(o, 1) for o in odd] + [(o, 1) for o in odd]
    data = [(i, v, lab, "x", 0) for i, (v, lab) in enumerate(rows)]
    frame = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, label int, key string, cls int")
    got = {r.vec_id: r for r in pigeonhole.near_vectors(frame, tile=tile).collect()}
    links = []
    for lab in (1, 2):
        mine = [(i, np.array(v, float)) for i, v, la, *_ in data
                if la == lab and v and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
        for n, (i, a) in enumerate(mine):
            links += [(i, j) for j, b in mine[n + 1:] if len(a) == len(b)
                      and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.98]
    want = brute.components([d[0] for d in data], links)
    degree = {d[0]: 0 for d in data}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert len(links) > 500
    assert {i: r.n_links for i, r in got.items()} == degree
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pigeonhole.near_vectors(frame).count() == 0
    frame = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)], frame.schema)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in pigeonhole.near_vectors(frame).collect())
    assert got == [(0, 2, 4), (4, 2, 4), (4, 2, 4)]


def test_agreeing_coordinates_follow_the_threshold():
    n = chosen_path.COORDINATES
    a = np.arange(n, dtype="<u2")
    for percent, agreeing in ((75, 47), (80, 54), (85, 60), (90, 69)):
        b = np.where(np.arange(n) < agreeing, a, a + 1000).astype("<u2")
        assert len(chosen_path._likely([a.tobytes(), b.tobytes()], [90, 100], percent)) == 1
        share = percent / 100
        least = chosen_path.least_agreeing(percent)
        lost = sum(math.comb(n, k) * share ** k * (1 - share) ** (n - k) for k in range(least))
        assert least <= agreeing and lost < 1e-6
    assert chosen_path.least_agreeing(85) == 60


@pytest.mark.parametrize("size", [100_000, 1_000_000])
def test_large_nodes_keep_threshold_pairs(size):
    """Pairs at 85 % that start in one node of each tree, over three levels that stay large."""
    draw, pairs = np.random.default_rng(size), 400
    a = draw.integers(0, 1 << 16, (pairs, chosen_path.COORDINATES)).astype("<u2")
    b = np.where(draw.random(a.shape) < 0.85, a, a + 1).astype("<u2")
    run = chosen_path._children(85, chosen_path.LEAF)
    nodes = [(p, 1_000 * p + t) for p in range(pairs) for t in range(chosen_path.TREES)]
    for _ in range(3):
        meet = []
        for side in (a, b):
            batch = pa.RecordBatch.from_arrays(
                [pa.array([n for _, n in nodes], pa.int64()), pa.array([size] * len(nodes), pa.int64()),
                 pa.array([str(p).encode() for p, _ in nodes], pa.binary()),
                 pa.array([side[p].tobytes() for p, _ in nodes], pa.binary())], names=["node", "size", "cls", "sketch"])
            meet.append({(int(c), n) for out in run([batch]) for n, c in zip(*(x.to_pylist() for x in out.columns))})
        held = {}
        for p, n in sorted(meet[0] & meet[1]):
            held.setdefault(p, []).append(n)
        nodes = [(p, n) for p, mine in held.items() for n in mine[:40]]
    assert len(held) >= pairs - 1
