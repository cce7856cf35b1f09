"""Licence and secret scans, fingerprints."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from servelog.llm import licenses, queries, secret_scan, simhash
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    return len(words), sorted((w, n) for n, (phrase, _) in enumerate(licenses.PHRASES)
                              for w in range(len(words)) if words[w:w + len(phrase.split())] == phrase.split())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("cc by CC BY general Public License all Rights reserved the gnu mit under é".split()),
                max_size=30), st.sampled_from([" ", "-", ". ", "\n"]))
def test_phrases(words, sign):
    text = sign.join(words)
    n, places, _ = licenses.Scanner().scan(text.encode())
    assert (n, [(w, p) for p, w in places]) == base_places(text)


def matching(words, templates):
    """Longest match up to each word, by looking everywhere."""
    out = []
    for end in range(1, len(words) + 1):
        out.append(max((k for k in range(end + 1) for t in templates for i in range(len(t) - k + 1)
                        if words[end - k:end] == t[i:i + k])))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=8), min_size=1, max_size=4),
       st.lists(st.integers(1, 4), max_size=12))
def test_matching_statistics(templates, words):
    graph = licenses.Automaton()
    for number, template in enumerate(templates):
        graph.add(number, template)
    graph.close()
    scanner = licenses.Scanner()
    scanner.graph = graph
    got = list(scanner.statistics(words))
    assert [n for _, n, _ in got] == matching(words, templates)
    for at, n, state in got:
        if n:
            want = {(k, i + n) for k, t in enumerate(templates) for i in range(len(t) - n + 1)
                    if t[i:i + n] == words[at + 1 - n:at + 1]}
            assert set(graph.ends[state]) == want


def test_spans_bridge_gaps():
    _, _, spans = licenses.Scanner().scan(
        b"x y Permission is hereby granted, free of charge (really), to any person obtaining a copy of this "
        b"software and associated documentation files (the \"Software\"), to deal in the Software without "
        b"restriction z")
    label = [licenses.Scanner().labels[s[0]] for s in spans]
    assert label == ["mit"] and spans[0][1:3] == (2, 32) and spans[0][3] == 1.0


def test_license_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_license_scan(spark, SF).collect():
        n, places = base_places(texts[r.doc_id])
        starts = [w for w, _ in places]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        labels = {licenses.PHRASES[p][1] for _, p in places}
        assert r.base_labels == ",".join(sorted(labels)) and 0 <= r.score <= 1
        assert labels <= set(filter(None, r.labels.split(",")))
        if "Released under the MIT License." in texts[r.doc_id]:
            assert "mit" in r.labels.split(",")


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


PIECES = ["password", "PassWd", "to", "ken", "secret", "api_key", "APIKEY", " ", "=", ":", '"', "'", "abcdefgh1",
          "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "ſecret", "toKen", "x", "-", "ghp_" + "a" * 36]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12), min_size=1, max_size=4))
def test_secrets(parts):
    texts = ["".join(p) for p in parts]
    scanner = secret_scan.Scanner(secret_scan.BASE + secret_scan.ADDED)
    got = scanner.scan(texts, [t.encode() for t in texts])
    for text, spans in zip(texts, got):
        assert [s for s in spans if s[1] < 3] == base_spans(text)
        assert [s for s in spans if s[1] >= 3] == sorted(
            (m.start(), n, m.end()) for n, rule in enumerate(scanner.rules) if n >= 3
            for m in rule[1].finditer(text))


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{32,}") is True
    assert secret_scan.trigram_query("AKIA[A-Z]+") == ("and", ("aki", "kia"))
    assert secret_scan.trigram_query("abc(x|def)?") == "abc"
    assert secret_scan.trigram_query("(abc|xy+)z") is True
    assert secret_scan.trigram_query("(?:abc|bcd)+x") == ("or", ("abc", "bcd"))


def test_secret_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kinds = [r.kind for r in secret_scan.BASE]
    for r in queries.op7_secret_scan(spark, SF).collect():
        spans = base_spans(texts[r.doc_id])
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_scans_of_odd_rows(spark):
    rows = [(1, None, "x"), (None, "", "y"), (1, "cc by token=abcdefgh", "z"), (1, "cc by token=abcdefgh", "z"),
            (2, "a " * 100_000 + "AKIA" + "B" * 40, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    assert sorted(len(r.places) for r in licenses.scan_licenses(docs).collect()) == [0, 0, 0, 1, 1]
    assert sorted(len(r.spans) for r in secret_scan.scan_secrets(docs).collect()) == [0, 0, 1, 1, 1]
    for scan in (licenses.scan_licenses, secret_scan.scan_secrets):
        assert scan(docs.where("false")).count() == 0


def test_fingerprints(spark):
    rows = [(5, "five " * 3), (9, None), (2, "é two words here"), (7, ""), (2, "another two é"), (None, "no id at all"),
            (1, "one"), (4, "w " * 70_000)]
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string")
    got = simhash.fingerprint_documents(docs.repartition(4)).collect()
    assert len(got) == len(rows)
    ordered = sorted((r for r in rows if r[0] not in (None, 2)), key=lambda r: -r[0])
    by_id = {r.doc_id: r for r in got}
    for k, (doc_id, text) in enumerate(ordered[:-1]):
        if ordered[k + 1][0] < 4:
            continue
        text, following = text or "", ordered[k + 1][1] or ""
        want = simhash.edited(text, following)
        assert by_id[doc_id].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert by_id[doc_id].n_chars == len(text)
    assert by_id[7].fingerprint == by_id[9].fingerprint == "0" * 32
    last = by_id[None]  # meets the first again
    assert last.edited_sha256 == hashlib.sha256(simhash.edited("no id at all", "").encode()).hexdigest()
    assert simhash.fingerprint_documents(docs.where("false")).count() == 0
    one = simhash.fingerprint_documents(docs.where("doc_id = 1")).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 3)]


def test_fingerprint_query(spark):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, SF).collect()}
    bits = {i: simhash.fingerprints([t.encode()])[0] for i, t in rows}
    for (doc_id, text), (other, following) in zip(rows, rows[1:] + rows[:1]):
        r, want = got[doc_id], simhash.edited(text, following).encode()
        assert r.edited_sha256 == hashlib.sha256(want).hexdigest()
        assert r.near_next == (bits[doc_id] == bits[other]).mean()
        assert r.near_edited == (bits[doc_id] == simhash.fingerprints([want])[0]).mean()
    assert sum(r.near_edited for r in got.values()) > sum(r.near_next for r in got.values()) + 0.1 * len(got)


def test_hamming_search(spark):
    import numpy as np
    random = np.random.default_rng(5)
    base = random.integers(0, 2, (30, 128), dtype="uint8")
    rows = [base]
    for flips in (1, 2, 3, 4):
        more = base.copy()
        for row in more:
            row[random.choice(128, flips, replace=False)] ^= 1
        rows.append(more)
    marks = [np.packbits(r).tobytes().hex() for r in np.concatenate(rows)]
    frame = spark.createDataFrame([(m,) for m in marks + marks[:5] + [None]], "fingerprint string")
    value = {m: int(m, 16) for m in marks}
    for blocks, keep in ((4, 1), (6, 2)):
        got = {(r.query, r.found): r.distance for r in simhash.near_fingerprints(
            frame, frame.limit(40), 3, blocks, keep).collect()}
        queries_ = {r.fingerprint for r in frame.limit(40).collect()}
        assert got == {(a, b): d for a in queries_ for b in value if (d := (value[a] ^ value[b]).bit_count()) <= 3}
