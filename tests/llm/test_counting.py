"""Tokens, length histogram and packing."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from servelog.llm import histogram, packing
from servelog.llm.tokens import encoder
from tests.llm import brute

ROWS = [(1, "a b  c", "s"), (2, None, "s"), (3, "", None), (3, "a b  c", "s"), (None, "x" * 30_000, "t"),
        (5, "word " * 5000, "t"), (6, "\n \n  end \n", "u"), (7, "<|endoftext|> is text", "u")]
SCHEMA = "doc_id long, text string, length string"


@pytest.fixture(scope="module")
def reference():
    return _tokenizer()


def ids_of(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab 1.'é\n\t\r\x0b ßЖ_-$\x1c\x85\u3000") + ["  ", "'s", " \n"]), max_size=24))
def test_ids_equal_the_tokenizers(parts):
    text = "".join(parts)
    assert np.frombuffer(encoder().ids(text), "<u4").tolist() == ids_of(_tokenizer(), text)


@lru_cache
def _tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_of_whole_corpus(spark, reference):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(encoder().ids(t), "<u4").tolist() for t in texts] == want


def test_histogram_suffix_sums(spark, reference):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    lengths = [len(ids_of(reference, r[1])) for r in ROWS]
    hist = histogram.length_histogram(histogram.encoded_lengths(docs))
    assert {r.length: r.n_docs for r in hist.collect()} == Counter(lengths)
    for r in histogram.suffix_table(hist).collect():
        assert r.docs_ge == sum(n >= r.length for n in lengths)
        assert r.tokens_ge == sum(n for n in lengths if n >= r.length)
        assert r.docs_le == sum(n <= r.length for n in lengths)
        assert r.tokens_le == sum(n for n in lengths if n <= r.length)
        assert r.truncated_total == sum(min(n, r.length) for n in lengths)
        assert r.share_le == sum(n <= r.length for n in lengths) / len(lengths)
    for r in histogram.at_limits(hist, [0, 3, 10_000]).collect():
        assert r.truncated_total == sum(min(n, r.limit) for n in lengths)
        assert (r.n_docs, r.total_tokens) == (len(lengths), sum(lengths))
        assert r.docs_over == sum(n > r.limit for n in lengths)
    low, mid = (next(r.length for r in histogram.quantiles(hist, [q]).collect()) for q in (0.01, 0.5))
    assert low == min(lengths) and mid == sorted(lengths)[len(lengths) // 2 - 1]


def test_histogram_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    assert histogram.encoded_lengths(docs, keep=["doc_id", "lang"]).columns == ["doc_id", "lang", "length"]
    empty = histogram.length_histogram(histogram.encoded_lengths(docs.where("false")))
    assert histogram.suffix_table(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plan_equals_best_fit_decreasing(lengths):
    windows = defaultdict(dict)
    for length, first, after, start, per, offset in packing.best_fit_decreasing(Counter(lengths), 32):
        for rank in range(first, after):
            nth = rank - first
            at = offset + nth % per * length
            assert at not in windows[start + nth // per]
            windows[start + nth // per][at] = length
    for window in windows.values():  # gapless from 0
        at = 0
        for place in sorted(window):
            assert place == at
            at += window[place]
        assert at <= 32
    want = brute.best_fit_decreasing(lengths, 32)
    # Of equally tight windows either may be taken; what is left open is the same.
    assert sorted(sum(w.values()) for w in windows.values()) == sorted(map(sum, want))
    assert Counter(n for w in windows.values() for n in w.values()) == Counter(lengths)


def test_pack_round_trip(spark, reference):
    random.seed(3)
    rows = ROWS + [(100 + i, " ".join(["tok"] * random.randint(0, 900)), "v") for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = Counter()
    for doc_id, text, _ in rows:
        ids = ids_of(reference, text) + [packing.END_ID]
        for at in range(0, len(ids), 2048):
            piece = ids[at:at + 2048]
            want[(doc_id, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(windows) == len(brute.best_fit_decreasing([k[2] for k in want.elements()], 2048))


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_does_not_depend_on_partitions(spark, monkeypatch):
    rows = [(i // 2, "word " * (i % 3)) for i in range(60)] + [(None, "same text")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (packing.BUCKET_PIECES, 4):
        monkeypatch.setattr(packing, "BUCKET_PIECES", bucket)
        one = sorted(map(str, packing.pack(docs.repartition(1), window=16).collect()))
        assert one == sorted(map(str, packing.pack(docs.orderBy(F.rand(3)).repartition(7), window=16).collect()))
        assert len(one) == 65
