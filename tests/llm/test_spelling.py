import random
import re
import zlib
from collections import Counter

from servelog.llm import spelling
from tests.llm.brute import lower


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows, every=97):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def expected(words):
    forms = {}
    for w, n in words.items():
        close = sorted((o for o in words if near(w, o)), key=lambda o: (-words[o], o))
        forms[w] = (close[0] if close and words[close[0]] >= 2 * n else None, len(close))
    out = set()
    for w, (form, k) in forms.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        out.add((w, form, root, words[w], k, words.get(form)))
    return out


def test_variants_against_brute_force(spark):
    draw = random.Random(3)
    stems = ["".join(draw.choice("abcé") for _ in range(draw.randint(4, 7))) for _ in range(30)] + ["aaaaaa", "aaaaa", "abbbbc"]
    words = {}
    for stem in stems:
        n = draw.choice([3, 10, 400])
        for _ in range(12):
            words[stem] = n
            at = draw.randrange(len(stem))
            stem = stem[:at] + draw.choice(["", "a", "ÿb", "é", stem[at] * 2]) + stem[at + 1:]
            n = max(3, n * draw.choice([1, 2, 4]) // 3)
    words = {w: n for w, n in words.items() if w}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.spelling_variants(table)
    assert {tuple(r) for r in got.collect()} == expected(words)
    pairs = [(r.word, r.near) for r in spelling.neighbours(table).collect()]
    assert len(pairs) == len(set(pairs))


def test_long_chains_reach_their_root(spark):
    chain = {"abcdefghijkl"[:5 + k]: 3 * 2 ** (8 - k) for k in range(8)}
    got = {r.word: r.root for r in spelling.spelling_variants(
        spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"abcde"} and len(got) == 8


def test_words(spark):
    draw = random.Random(9)
    vocabulary = ["".join(draw.choice("abcdeÀß") for _ in range(draw.randint(1, 8))) for _ in range(80)]
    rows = [(i if i % 17 else None, " ".join(draw.choice(vocabulary) for _ in range(120)) + "-Straße×x÷") for i in range(150)]
    rows += rows[:5] + [(7, None), (8, ""), (9, "Ωmega abcdeabcde " * 20_000), (10, "z" * 300_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    for every in (97, 3):
        got = {r.word: r.n for r in spelling.words(docs, every=every).collect()}
        assert got == counted(rows, every)


def test_empty(spark):
    none = spelling.words(spark.createDataFrame([], "doc_id long, text string"))
    assert spelling.spelling_variants(none).count() == 0
