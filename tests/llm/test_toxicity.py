import random
from functools import lru_cache

import numpy as np
import pytest

from servelog.llm import toxicity

INSULTS = ("blorgnat", "fizwuckle", "grudlep", "snarfuzzle")


def kernel(a, b, size, decay):
    """Subsequence kernel by its recursive definition."""
    @lru_cache(None)
    def inner(k, m, n):
        if k == 0:
            return 1.0
        if min(m, n) < k:
            return 0.0
        return decay * inner(k, m - 1, n) + sum(
            inner(k - 1, m - 1, j) * decay ** (n - j + 1) for j in range(n) if b[j] == a[m - 1])

    def whole(m):
        if m < size:
            return 0.0
        return whole(m - 1) + sum(inner(size - 1, m - 1, j) * decay ** 2 for j in range(len(b)) if b[j] == a[m - 1])

    return whole(len(a))


def test_kernel():
    draw = random.Random(2)
    words = ["".join(draw.choice("abcé") for _ in range(draw.randint(3, 9))) for _ in range(40)]
    a, b = words[:20], words[20:]
    got = toxicity.subsequence_kernel(toxicity._codes(a, 9, -1), toxicity._codes(b, 9, -2))
    want = [kernel(x, y, toxicity.SUBSEQUENCE, toxicity.DECAY) for x, y in zip(a, b)]
    assert np.allclose(got, want, rtol=1e-4)


def test_features_are_normalised():
    marks = toxicity.Landmarks(["idiot", "trash", "réeuxpa"])
    i, j, value = marks.features(["trash", "tra-sh", "réeuxpa", "elephant", "trrash"])
    table = {(a, b): v for a, b, v in zip(i.tolist(), j.tolist(), value.tolist())}
    assert table[0, 1] == pytest.approx(1) and table[2, 2] == pytest.approx(1)
    assert 0.05 < table[1, 1] < 1 and 0.05 < table[4, 1] < 1
    assert not any(a == 3 for a, _ in table)


def test_features_are_the_kernel():
    """Two inserted letters, an insult in a run of letters, and strings at random."""
    draw = random.Random(8)
    marks = ["stupid", "loser", "moron", "idiot", "réeuxpa"]
    words = ["stuxpixd", "lzozser", "mxorxon", "youstupididiot", "moxron", "xyxyxyxyxstupidxyxyxyxyx", "qqqq", "i.d-i0t"]
    words += ["".join(draw.choice("stupidlorme") for _ in range(draw.randint(3, 24))) for _ in range(60)]
    size, decay = toxicity.SUBSEQUENCE, toxicity.DECAY
    got = np.zeros((len(words), len(marks)))
    i, j, value = toxicity.Landmarks(marks).features(words)
    got[i, j] = value
    own = lambda w: kernel(w, w, size, decay)
    want = np.array([[(kernel(w, m, size, decay) / max(own(w) * own(m), 1e-12) ** 0.5) ** toxicity.SHARPEN for m in marks] for w in words])
    assert np.allclose(got, np.where(want >= toxicity.SMALL, want, 0), rtol=1e-3, atol=2e-5)
    assert got[0, 0] > 0.04 and got[1, 1] > 0.015 and got[2, 2] > 0.01 and got[3, 0] > 0.08


def test_windows_fit_landmarks():
    marks = toxicity.Landmarks(["scum", "stupid", "blorgnat"])
    for n, insult in enumerate(marks.words):
        for before in range(40, 60):
            i, j, value = marks.features(toxicity.units("xyz" * before + insult + "qwv" * 50))
            assert value[j == n].max() > 0.04


def test_units():
    assert toxicity.units("Trash!!".lower()) == ["trash"]
    assert "idiot" in toxicity.units("i.d.i.o.t") and "scum" in toxicity.units("sc-um,")
    assert toxicity.units("...") == [] and toxicity.units("a") == []
    long = "x" * 5000 + "trash" + "y" * 5000
    assert all(len(u) <= toxicity.LONGEST for u in toxicity.units(long))
    assert any("trash" in u for u in toxicity.units(long))
    assert "moron" in toxicity.tokens_of("the m o r o n here") and toxicity.tokens_of(None) == set()


def corpus(n=900, seed=4):
    draw = random.Random(seed)
    common = ["".join(draw.choice("abcdefghilmnoprstu") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [draw.choice(common) for _ in range(draw.randint(5, 300))]
        toxic = i % 8 == 0
        for _ in range(draw.randint(2, 4) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] + ("x",) for r in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (10 ** 9, 1)],
                                   "doc_id long, toxic int")
    return toxicity.train(docs, labels.where("doc_id is null or doc_id % 4 <> 2"))


def test_held_out(spark, model):
    rows = [r for r in corpus(seed=77)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = sum((got[i] >= 0.3) == bool(toxic) for i, _, toxic in rows)
    assert right / len(rows) > 0.97


def test_inserted_and_gapped(spark, model):
    clean = "some harmless words stand here in a row"
    forms = [f"{clean} {INSULTS[0]} {INSULTS[1]}", f"{clean} bl-orgnat f.i.z.w.u.c.k.l.e", f"{clean} b l o r g n a t fizwuckle",
             f"{clean} blorrgnat fizwucklee", f"{clean} BLORGNAT!!! FIZWUCKLE$$$"]
    docs = spark.createDataFrame([(i, f, 0) for i, f in enumerate([clean, *forms])], "doc_id long, text string, score int")
    got = [r[0] for r in docs.select("doc_id", toxicity.scorer(model)("text").alias("s")).orderBy("doc_id").select("s").collect()]
    assert got[0] < 0.2 and min(got[1:]) > 0.5


def test_odd_rows_and_place_in_long_texts(spark, model):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None), (1, None), (None, ""), (2, f"{long} {INSULTS[0]} {INSULTS[2]}"), (3, long)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    none = [r.score for r in got if not r.text]
    assert len(got) == 5 and len(set(none)) == 1 and 0 <= none[0] < 0.3
    assert next(r.score for r in got if r.doc_id == 2) > 0.5 > next(r.score for r in got if r.doc_id == 3)


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    for rows, want in (([], 0.5), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        flat = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score(docs, flat).collect()] == pytest.approx([want] * 2, abs=0.01)
    assert toxicity.score(docs.where("false"), flat).count() == 0


def test_query(spark):
    from zlib import crc32

    from servelog.llm import queries
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in got.items():
        assert r.held_out == (crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    mean = [np.mean([r.score for i, r in got.items() if r.held_out and labels.get(i) == k]) for k in (0, 1)]
    assert mean[1] > mean[0] + 0.3


def test_two_insertions_and_runs_of_letters(spark, model):
    clean = "some harmless words stand here in a row"
    run = "bcdafeghilmnoprstu" * 3
    forms = [f"{clean} blxorgxnat fizwqucklqe", f"{clean} {run}{INSULTS[0]}{run} {INSULTS[1]}{run}"]
    docs = spark.createDataFrame([(i, f) for i, f in enumerate([clean, clean + f" {run}", *forms])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(got[2], got[3]) > max(got[0], got[1])


def test_one_insult_raises_the_score(spark, model):
    """Plain, starred, spelled and inside a longer run; another one never lowers it."""
    clean = "some harmless words stand here in a row"
    forms = [clean, f"{clean} {INSULTS[1]}", f"{clean} {INSULTS[1].replace('i', '1').replace('e', '3')}",
             f"{clean} {INSULTS[1][:3]}*{INSULTS[1][4:]}", f"{clean} {INSULTS[1]}. {clean} {INSULTS[2]}"]
    got = model.scores(model.worst(forms))
    assert min(got[1:4]) >= 0.3 > got[0] and got[4] >= got[1]
    assert (model.logistic[1:] >= 0).all() and model.by_word[1] >= 0


def test_near_copies_are_counted_once(spark):
    draw = random.Random(1)
    base = [f"w{draw.randrange(900)}" for _ in range(200)]
    copies = [" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in range(12)]
    others = [" ".join(f"w{draw.randrange(900)}" for _ in range(200)) for _ in range(12)]
    rows = [(str(i), t, 1, toxicity._copy_keys(t)) for i, t in enumerate(copies + others)]
    kept = toxicity._distinct(spark.createDataFrame(rows, "doc_id string, text string, toxic int, keys array<long>"))
    assert sorted(int(r.doc_id) for r in kept.collect()) == [0, *range(12, 24)]
