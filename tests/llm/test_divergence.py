import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from servelog.llm import divergence
from tests.llm.brute import lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, value string, rank string"


def expected(rows, least=10, top=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall(lower(text))
        groups.add((lang, source))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        counts = {s: [count[lang, s][t] for t in kept] for s in sources}
        smooth = lambda row: [1 + 10 ** 9 * (c + 2) // (sum(row) + 2 * len(kept)) for c in row]  # noqa: B023, E731
        p, q = {s: smooth(row) for s, row in counts.items()}, smooth([sum(c) for c in zip(*counts.values())])
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(map(gap, p[s], p[o]))) for o in sources if o != s]
            terms = [(t, gap(a, b)) for t, c, a, b in zip(kept, counts[s], p[s], q) if c and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                best = sorted(found, key=lambda f: (-f[1], f[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(best[:top if part == "term" else None], 1)]
    return sorted(out)


def corpus(n, seed, sources=7):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abéЖz") for _ in range(draw.randint(1, 3))) for _ in range(60)]
    rows = []
    for i in range(n):
        source = None if i % 19 == 0 else f"s{draw.randrange(sources)}"
        text = " ".join(draw.choice(words[:5 + (i % 50)]).title() + draw.choice(["", "1", ".", "_"]) for _ in range(draw.randrange(40)))
        rows.append((text if i % 11 else None, draw.choice(["en", "de", None, "x"] if i % 3 else ["en"]), source))
    return rows + rows[:9] + [("", "lonely", "a"), (None, "lonely", "b"), ("ß " * 5000, "single", "a")]


@pytest.mark.parametrize("seed,least", [(1, 10), (2, 3), (3, 1)])
def test_against_brute_force(spark, seed, least):
    rows = corpus(260, seed)
    docs = spark.createDataFrame([(i, *r, "v", "r") for i, r in enumerate(rows)], SCHEMA)
    got = divergence.source_divergence(docs, least_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, least)


def test_empty(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    n, whole = 7 * 10 ** 15, 9 * 10 ** 16
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(whole), F.lit(5).cast("long"))).first()[0]
    assert got == 1 + 10 ** 9 * (n + 2) // (whole + 10)


def test_shared_paths_are_corrected_once():
    """Rows that start alike: fewer node-ancestor pairs than pairs of entries, the same sums."""
    draw = random.Random(5)
    paths = sorted({tuple((r, draw.randint(1, 2)) for r in range(1, 7) if draw.random() < 0.8) for _ in range(90)} - {()})
    times = np.array([draw.randint(1, 4) for _ in paths])
    starts = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    rank = np.array([r for p in paths for r, _ in p], "int32")
    p = np.array([1000 + 700 * r * c for path in paths for r, c in path], "int64")
    zero = 500 + 3 * rank.astype("int64")
    seen, gaps = [], divergence._gap
    divergence._gap = lambda a, b: (seen.append(len(a)), gaps(a, b))[1]
    try:
        out = [r for b in divergence._tree("x", rank, p, zero, starts, times) for r in b.to_pylist()]
    finally:
        divergence._gap = gaps
    want, header = Counter(), Counter()
    for path, n in zip(paths, times.tolist()):
        full = [(r, 1000 + 700 * r * c, 500 + 3 * r) for r, c in path]
        for k, (r, a, za) in enumerate(full):
            header[r, a] += n
            for s, b, zb in full[:k]:
                want[r, s] += n * sum(sign * (x - y) ** 2 // (x + y) if sign > 0 else -((x - y) ** 2 // (x + y))
                                      for sign, x, y in ((1, a, b), (-1, a, zb), (-1, za, b), (1, za, zb)))
    got, heads = Counter(), Counter()
    for r in out:
        if r["lo"] is None:
            heads[r["hi"], r["p"]] += r["value"]
        else:
            got[r["hi"], r["lo"]] += r["value"]
    assert got == want and heads == header
    assert max(seen) < sum(len(path) * (len(path) - 1) // 2 for path in paths)
