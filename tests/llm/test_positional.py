import random
import re

import pytest

from servelog.llm import positional
from tests.llm.brute import lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def expected(docs, items, size=10, slack=None):
    windows = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[i:i + size]), set()).add(item or "")
    out = []
    for doc_id, text in docs:
        words, hit, found, close = WORD.findall(lower(text)), set(), set(), set()
        for window, ids in windows.items():
            k = len(window)
            for i in range(len(words) - k + 1):
                if tuple(words[i:i + k]) == window:
                    hit |= set(range(i, i + k))
                    found |= ids
            if slack is not None and any(set(window) <= set(words[i:i + k + slack]) for i in range(len(words))):
                close |= ids
        out.append((doc_id, len(words), len(hit), tuple(sorted(found)), tuple(sorted(close))))
    return sorted(out, key=repr)


def found(index, table, **more):
    rows = positional.phrase_matches(index, table, **more).collect()
    for r in rows:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted([(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"]), tuple(r.close))
                   for r in rows], key=repr)


def corpus(seed, n=60):
    draw = random.Random(seed)
    words = ["a", "B", "c3", "été", "Ж", "ff"]
    text = lambda k: draw.choice([" ", ", ", "\n"]).join(draw.choice(words) for _ in range(k))
    items = [(f"i{k}", text(draw.choice([1, 2, 4, 9, 10, 11, 30]))) for k in range(25)]
    items += [("i3", "another text of i3"), (None, "c3 c3 ff"), ("i90", ""), ("i91", None), ("i92", "-- !")]
    docs = []
    for i in range(n):
        body = text(draw.randrange(60))
        for _ in range(draw.randrange(3)):
            body += " " + (draw.choice(items)[1] or "") if draw.random() < 0.7 else " zz"
        docs.append((i, body.upper() if i % 5 == 0 else body))
    return docs + docs[:4] + [(None, "a b"), (5, None), (6, ""), (7, "...")], items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, places int"),
            spark.createDataFrame([(*i, 2) for i in items], "item_id string, text string, doc_id int"))


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_and_proximity(spark, seed):
    docs, items = corpus(seed)
    d, i = frames(spark, docs, items)
    index = positional.build_index(d)
    assert found(index, i, slack=2) == expected(docs, items, slack=2)
    assert found(index, i, size=4) == expected(docs, items, size=4)


def test_test_set_in_pieces(spark, monkeypatch):
    docs, items = corpus(4)
    d, i = frames(spark, docs, items)
    index = positional.build_index(d)
    monkeypatch.setattr(positional, "PIECE_WORDS", 60)
    assert positional._pieces(i, "text", "item_id", 10)[1] > 2
    assert found(index, i, slack=1) == expected(docs, items, slack=1)


def test_long_documents_and_items(spark):
    """A document of several segments with a passage over each border, an item of several parts."""
    draw = random.Random(8)
    words = [f"w{draw.randrange(5000)}" for _ in range(2 * positional.BLOCK_WORDS + 5000)]
    passages = {}
    for at in (0, positional.BLOCK_WORDS - 5, positional.BLOCK_WORDS + 7, 2 * positional.BLOCK_WORDS - 9, len(words) - 10):
        passages[f"p{at}"] = [f"q{at}x{k}" for k in range(10)]
        words[at:at + 10] = passages[f"p{at}"]
    items = [(k, " ".join(v)) for k, v in passages.items()]
    tail = words[-positional.ITEM_WORDS - 100:]
    items.append(("long", " ".join(tail)))
    d, i = frames(spark, [(1, " ".join(words)), (2, "w1 w2")], items)
    got = {r.doc_id: r for r in positional.phrase_matches(positional.build_index(d), i).collect()}
    assert got[1].n_words == len(words) and got[2].n_words == 2 and not got[2].spans
    assert sorted(got[1]["items"]) == sorted(k for k, _ in items)
    covered = {w for s in got[1].spans for w in range(s.start, s.end)}
    want = {at + k for at in (0, positional.BLOCK_WORDS - 5, positional.BLOCK_WORDS + 7, 2 * positional.BLOCK_WORDS - 9) for k in range(10)}
    assert covered == want | set(range(len(words) - len(tail), len(words)))


def test_empty_tables(spark):
    docs, items = corpus(6, 8)
    d, i = frames(spark, docs, items)
    assert positional.phrase_matches(positional.build_index(d.where("false")), i).count() == 0
    assert found(positional.build_index(d), i.where("false")) == expected(docs, [])
    with pytest.raises(ValueError):
        positional.phrase_matches(positional.build_index(d), i, slack=60)
