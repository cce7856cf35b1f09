import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from servelog.llm import surrogates as s

KEY = b"test key"
TEXT = ("Write to und.34@mail7.example.com or UND.34@Mail7.example.com, call +1 (017) 555-7713 or +10175557713. "
        "From 97.51.17.173 with 4242 4242 4242 4242 or 9807915762804490, DE89 3704 0044 0532 0130 00, 123-45-6789. "
        "Frau Anna-Lena Müller met Mr. John Smith and Господин Иван Петров. Version 1.2.3, 2024-01-02, 12345.")


@pytest.mark.parametrize("size", [1, 2, 10, 97, 1000, 5000])
def test_permutation(size):
    assert sorted(s.permuted(i, size, KEY, "t") for i in range(size)) == list(range(size))
    assert size < 97 or [s.permuted(i, size, b"other", "t") for i in range(size)] != [
        s.permuted(i, size, KEY, "t") for i in range(size)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcé-.0123жü", max_size=14))
def test_shape(text):
    new = s.reshaped(text, KEY, "t")
    kinds = lambda t: ["d" if c.isdigit() else s._alphabet(c) if c.isalpha() else c for c in t]
    assert kinds(new) == kinds(text)


def test_rewrite():
    new, rows = s.rewrite(TEXT, KEY)
    assert [r[2] for r in rows] == ["email", "email", "phone", "phone", "ip", "card", "card", "iban", "ssn",
                                    "name", "name", "name"]
    for start, end, kind, _, made in rows:
        old = TEXT[start:end]
        assert old not in new and made in new and len(made) <= len(old) + 3
        assert [c.isupper() for c in made] == [c.isupper() for c in old] or kind in ("ip", "email")
        if kind != "ip":
            assert re.sub(r"\w", "x", made) == re.sub(r"\w", "x", old)
    made = [r[4] for r in rows]
    assert made[0].lower() == made[1].lower() and re.sub(r"\D", "", made[2]) == re.sub(r"\D", "", made[3])
    luhn = lambda t: s._luhn(d[:-1]) == int(d[-1]) if (d := re.sub(r"\D", "", t)) else None
    assert luhn(made[5]) and luhn(made[6]) == luhn("9807915762804490")
    assert made[9].split()[0][-1] == "a" and "Frau" in new and "Mr." in new  # gender stays
    assert all("а" <= c <= "я" for c in made[11].lower().replace(" ", ""))  # script stays
    assert new.endswith("Version 1.2.3, 2024-01-02, 12345.")
    assert s.rewrite("Clean text, 12 of 300 words; no more.", KEY) == ("Clean text, 12 of 300 words; no more.", [])


@pytest.mark.parametrize("inner", ["ann.5550000000@clinic.org", "root@10.0.1.7"])
def test_many_entities_in_one_text(inner):
    text = " ".join([inner] * 300)
    assert s.entities(text) == [(at, at + len(inner), "email") for at in range(0, len(text), len(inner) + 1)]
    one = s.rewrite(inner, KEY)[0]
    assert s.rewrite(text, KEY)[0] == " ".join([one] * 300)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12), st.sampled_from("ab")), max_size=40))
def test_overlaps_go_to_the_longer_then_the_earlier(spans):
    chain = [(a, a + n, k) for a, n, k in spans]
    kept = []
    for e in sorted(chain, key=lambda e: (e[0] - e[1], e[0])):
        if all(e[1] <= k[0] or k[1] <= e[0] for k in kept):
            kept.append(e)
    assert s._apart(chain) == sorted(kept)


def test_names_with_hyphens_and_apostrophes():
    new, rows = s.rewrite("Dr Anna-Maria Müller-Lüdenscheidt, Mr O'Brien's dog and Mrs D’Arcy.", KEY)
    for part in ("Anna", "Maria", "Müller", "Lüdenscheidt", "Brien", "Arcy"):
        assert part not in new
    assert [r[2] for r in rows] == ["name"] * 3
    assert re.fullmatch(r"Dr [A-Z]\w+-[A-Z]\w+ [A-Z]\w+-[A-Z]\w+, Mr [A-Z]'[A-Z]\w{4}'s dog and Mrs [A-Z]’[A-Z]\w{3}\.", new)


def test_later_mentions_are_the_same_person():
    text = ("Mary! Mrs Mary Jones met Mr. John Smith-Young. JONES thanked Smith and Young; Mary's car, John's, "
            "Jones-Smith. Frau Weiß ist weiß, Weiß. Jonesy, mary.")
    new, rows = s.rewrite(text, KEY)
    mary, jones = re.search(r"Mrs (\w+) (\w+)", new).groups()
    john, smith, young = re.search(r"Mr\. (\w+) (\w+)-(\w+)\.", new).groups()
    assert f"{jones.upper()} thanked {smith} and {young}; " in new and f"car, {john}'s, {jones}-{smith}." in new
    # "mary" and "weiß" also stand in lower case, so other places of them may be plain words.
    assert new.startswith("Mary! ") and "; Mary's" in new and new.endswith(" ist weiß, Weiß. Jonesy, mary.")
    assert s.rewrite("John Smith and Mary", KEY) == ("John Smith and Mary", [])
    kinds = [(text[a:b], k) for a, b, k, _, _ in rows]
    assert ("John", "given") in kinds and ("Young", "name") in kinds


def test_valid_ibans_stay_valid_and_all_stay_distinct():
    for iban in ("DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"):
        assert s.iban_rest(iban) == 1
        made = s.surrogate("iban", iban, KEY)[1]
        assert s.iban_rest(made) == 1 and made != iban and made[:2] == iban[:2]
    every = [f"DE{c:02d}3704004405320130{k:02d}" for c in range(100) for k in range(20)]
    made = [s.surrogate("iban", i, KEY)[1] for i in every]
    assert len(set(made)) == len(every)
    assert all((s.iban_rest(a) == 1) == (s.iban_rest(b) == 1) for a, b in zip(every, made) if 2 <= int(a[2:4]) <= 98)


def test_addresses_stay_in_their_block():
    import ipaddress
    named = ["10.0.0.1", "127.0.0.1", "192.168.1.7", "172.31.0.9", "169.254.3.3", "224.0.0.5", "8.8.8.8", "100.64.9.9",
             "0.0.0.0", "255.255.255.0", "198.51.100.7"]
    for kind in ("is_private", "is_loopback", "is_multicast", "is_link_local", "is_global", "is_reserved"):
        for ip in named + [f"{i}.{i * 7 % 256}.3.4" for i in range(256)]:
            made = s.surrogate("ip", ip, KEY)[1]
            if not made.startswith(("192.", "198.", "203.")):  # blocks of single protocols are not told apart
                assert getattr(ipaddress.ip_address(ip), kind) == getattr(ipaddress.ip_address(made), kind), (ip, made)
    small = [f"198.51.100.{i}" for i in range(256)]
    assert sorted(s.surrogate("ip", i, KEY)[1] for i in small) == sorted(small)


def test_numbers_that_are_no_phones_or_cards():
    for text in ("At 1700000000 order 123456789012 came.", "Part 4242424242424.", "Row 98079157627644901."):
        assert s.rewrite(text, KEY) == (text, [])
    found = lambda text: [(text[a:b], k) for a, b, k in s.entities(text)]
    assert found("Tel.: 5551234567, call 03012345678") == [("5551234567", "phone"), ("03012345678", "phone")]
    assert found("4222222222222 and 378282246310005") == [("4222222222222", "card"), ("378282246310005", "card")]
    one = [re.sub(r"\D", "", r[4])[-10:] for r in s.rewrite(
        "(555) 123-4567, +1 555 123 4567, 1 (555) 123-4567, 555-123-4567", KEY)[1]]
    assert len(one) == 4 and len(set(one)) == 1


def test_distinct_and_coreferent():
    emails = [f"a{i}.b@mail{j}.example.com" for i in range(60) for j in range(10)]
    cards = [f"{4 * 10**15 + 7 * i}" for i in range(2000)]
    ips = [f"10.{i}.{j}.7" for i in range(40) for j in range(40)]
    for kind, found in (("email", emails), ("card", cards), ("ip", ips)):
        made = [s.surrogate(kind, f, KEY)[1] for f in found]
        assert len(set(made)) == len(found)


def test_documents(spark):
    rows = [(1, TEXT, 0, "e"), (1, TEXT, 0, "e"), (2, None, 7, "e"), (None, "", 7, "e"), (3, "clean", 99, "e"),
            (4, "x " * 50_000 + "und.34@mail7.example.com", 0, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, entities string").drop("entities")
    out = s.replace_checked(docs, key=KEY).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0] == by[1][1] and len(by[1][0].entities) == 12 and by[1][0].n_chars == len(by[1][0].text)
    assert by[2][0].text is None and by[2][0].n_chars == 7 and by[None][0].text == ""
    assert by[3][0].n_chars == 99 and by[3][0].entities == []
    assert by[4][0].entities[0].surrogate == by[1][0].entities[0].surrogate  # in every document
    assert s.replace_checked(docs.where("false")).count() == 0
    clash = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, entities string")
    kept = s.replace_checked(clash, out="__e").drop("__e")
    assert kept.columns == clash.columns and {r.entities for r in kept.collect()} == {"e"}


def test_collisions_are_found(spark, monkeypatch):
    docs = spark.createDataFrame([("a1@mail1.example.com b2@mail1.example.com",)], "text string")
    assert s.collisions(docs).count() == 0
    calls = []
    monkeypatch.setattr(s, "collisions", lambda d, t, k, epoch: calls.append(epoch) or (
        docs if epoch < 2 else docs.where("false")))
    s.replace_checked(docs)
    assert calls == [0, 1, 2]
    with pytest.raises(ValueError):
        s.replace_checked(docs, epochs=2)


def test_query(spark):
    from servelog.llm import queries
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_pii_surrogates(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        old = texts[r.doc_id]
        assert r.n_entities == len(r.entities) and (r.n_entities > 0) == (r.text != old)
        for e in r.entities:
            assert old[e.start:e.end] not in r.text or len(old) < 8
    assert sum(r.n_entities for r in got) > 0
