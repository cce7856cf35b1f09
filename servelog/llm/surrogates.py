"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Every surrogate is a keyed permutation of all strings of the entity's shape: letters
stay letters of their script and case, digits digits, signs stay. A permutation sends
different entities to different surrogates and one entity to one surrogate, in every
document, without a table of entities. Check digits of cards and IBANs stay right or wrong
as they were; titles and the last letter of a given name stay, and with them its gender.
Addresses stay in their block: a private one gives a private one.

Names are found after titles; their words may hold hyphens and apostrophes. Where such a
word stands alone, capitalised, anywhere in the same text, it gets the surrogate it has in
the name, unless the text also has it in lower case. Digits alone are a phone number only
after a word that says so; of digits alone, sixteen are a card whatever their check digit.

``collisions`` checks distinctness over all entities of the corpus; ``replace_checked``
takes the next key epoch until it finds none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = b"a key for tests; pass your own"
ROUNDS = 8
# Titles, those of women last.
TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Dr", "Prof", "Господин",
          "Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Госпожа")
_ALPHABETS = ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
_EMAIL = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")
_DIGIT = re.compile(r"\d")
_NUMBERS = re.compile(
    r"(?<![\w.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?![\w]|\.\d)"
    r"|(?<![\w])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w])(?P<card>\d{4}(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w)"
    r"|(?<![\w])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w+])(?P<phone>(?:\+\d{1,3}[ .-]?|\d[ .-])?\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}(?P<sep>[-. ])\d{3}(?P=sep)\d{4}|0\d{2,4}[ /-]\d{5,8}|\d{9,12})(?!\w)")
_PHONE_CUE = re.compile(r"(?:phone|tel|tél|telefon|teléfono|téléphone|mobile|mobil|cell|call|fax|handy)[.:]?:? ?$", re.I)
_TOKEN = r"[^\W\d_](?:['’-]?[^\W\d_])+"
_WORD = re.compile(_TOKEN)
_NAME = re.compile(r"(?<!\w)(?:" + "|".join(sorted(TITLES, key=len, reverse=True))
                   + rf")\.?[ \u00a0]({_TOKEN}(?:[ \u00a0]{_TOKEN}){{0,2}})")
_OWNS = re.compile("['’]s$")
# Address blocks with a meaning of their own, (first address, bits of a host).
_BLOCKS = ((0x00000000, 24), (0x0A000000, 24), (0x64400000, 22), (0x7F000000, 24), (0xA9FE0000, 16),
           (0xAC100000, 20), (0xC0000200, 8), (0xC0A80000, 16), (0xC6336400, 8), (0xCB007100, 8),
           (0xE0000000, 28), (0xF0000000, 28))


@lru_cache(maxsize=4096)
def _alphabet(letter: str) -> str:
    """Lower-case letters of a letter's script that may stand in its place; vowels and
    consonants of the Latin base letters keep their kind."""
    if letter in "aeiou":
        return "aeiou"
    if "a" <= letter <= "z":
        return "bcdfghjklmnpqrstvwxyz"
    for letters in _ALPHABETS:
        if letter in letters:
            return letters
    first = ord(letter) & ~0x3F
    return "".join(c for c in map(chr, range(first, first + 64))
                   if c.isalpha() and not any(c in letters for letters in _ALPHABETS) and c == c.lower() and len(c.upper()) == 1)


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: a Feistel network, walked until it is inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for turn in range(ROUNDS):
            data = b"%d/%s/%s" % (turn, tweak.encode(), right.to_bytes(width, "big"))
            mac = hashlib.blake2b(data, key=key, digest_size=32).digest()
            if width > 32:
                mac = hashlib.shake_256(mac).digest(width)
            left, right = right, left ^ (int.from_bytes(mac, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def reshaped(text: str, key: bytes, tweak: str, fixed: frozenset[int] = frozenset()) -> str:
    """Permutes lower-case ``text`` within its shape; places in ``fixed`` stay."""
    slots: list[tuple[int, str]] = []
    for at, c in enumerate(text):
        letters = "" if at in fixed else "0123456789" if c in "0123456789" else \
            _alphabet(c) if c.isalpha() else ""
        if c in letters:
            slots.append((at, letters))
    if not slots:
        return text
    value, size = 0, 1
    for at, letters in slots:
        value, size = value * len(letters) + letters.index(text[at]), size * len(letters)
    # The shape and what stays are part of the tweak, so each shape has its own permutation.
    out = list(text)
    for at, _ in slots:
        out[at] = "#"
    value = permuted(value, size, key, tweak + "|" + "".join(out))
    out = list(text)
    for at, letters in reversed(slots):
        value, digit = divmod(value, len(letters))
        out[at] = letters[digit]
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = int(c) * (2 if at % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _digits(kind: str, digits: str, key: bytes, plus: bool = False) -> str:
    if kind == "card":
        body = reshaped(digits[:-1], key, "card")
        return body + str((_luhn(body) + int(digits[-1]) - _luhn(digits[:-1])) % 10)
    return reshaped(digits, key, kind + "+" * plus, frozenset({0}) if plus else frozenset())


def _ip(text: str, key: bytes) -> str:
    value = int.from_bytes(bytes(int(p) for p in text.split(".")), "big")
    block = _block(value)
    if block:
        value = block[0] | permuted(value - block[0], 1 << block[1], key, "ip%x" % block[0])
    else:  # a permutation of all addresses, walked until it is outside of the blocks again
        value = permuted(value, 1 << 32, key, "ip")
        while _block(value):
            value = permuted(value, 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _block(address: int) -> tuple[int, int] | None:
    return next((b for b in _BLOCKS if address >> b[1] == b[0] >> b[1]), None)


def iban_rest(plain: str) -> int:
    """The number of an IBAN modulo 97; 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _iban(plain: str, key: bytes) -> str:
    """The account is permuted, the check digits leave the same rest as before. Digits no rest
    leads to (00, 01, 99) stay, so different IBANs stay different."""
    country, check = plain[:2], plain[2:4]
    body = reshaped((country + "00" + plain[4:]).lower(), key, "iban", frozenset(range(4)))[4:].upper()
    if 2 <= int(check) <= 98:
        check = "%02d" % ((iban_rest(plain) - iban_rest(country + "00" + body) - 2) % 97 + 2)
    return country + check + body


def _cased(new: str, like: str) -> str:
    return "".join(n.upper() if c != c.lower() and len(n.upper()) == 1 else n for n, c in zip(new, like))


def _name_word(word: str, role: str, key: bytes) -> str:
    """Parts between hyphens have surrogates of their own, since they also stand alone."""
    return "-".join(_cased(reshaped(_lower(part), key, role, frozenset({len(part) - 1})), part)
                    for part in word.split("-"))


def _lower(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=100_000)
def surrogate(kind: str, found: str, key: bytes) -> tuple[str, str]:
    """(what identifies the entity, the surrogate in the form it was found in)."""
    if kind == "email":
        plain = _lower(found)
        local, _, domain = plain.rpartition("@")
        labels = domain.split(".")
        new = reshaped(local, key, "local") + "@" + ".".join(
            [reshaped(label, key, "label") for label in labels[:-1]] + labels[-1:])
        return plain, _cased(new, found)
    if kind == "name":
        words = re.split(r"([  ])", found)
        given = len(words) > 1
        new = [w if at % 2 else _name_word(w, "given" if given and at == 0 else "family", key)
               for at, w in enumerate(words)]
        return " ".join(_lower(w) for w in words[::2]), "".join(new)
    if kind == "ip" and all(int(p) < 256 and str(int(p)) == p for p in found.split(".")):
        return found, _ip(found, key)
    if kind == "iban":
        plain = found.replace(" ", "")
        new = iter(_iban(plain, key))
        return plain, "".join(c if c == " " else next(new) for c in found)
    if kind == "ip":
        return found, reshaped(found, key, "ip-like")
    if kind == "given":
        return _lower(found), _name_word(found, "given", key)
    digits = "".join(c for c in found if c.isdigit())
    if kind == "phone" and len(digits) == 11 and re.match(r"\+1|1[ .(-]", found):
        # A number of ten digits, with and without its country.
        new = iter(digits[0] + _digits(kind, digits[1:], key))
        return digits[1:], "".join(next(new) if c.isdigit() else c for c in found)
    plus = kind == "phone" and found.lstrip("(").startswith("+")
    new = iter(_digits(kind, digits, key, plus))
    return "+" * plus + digits, "".join(next(new) if c.isdigit() else c for c in found)


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) without overlaps: of two the longer, then the earlier."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            kind = next(k for k in ("ip", "ssn", "card", "iban", "phone") if m.group(k))
            digits = m.group()
            if digits.isdigit() and kind == "phone" and not _PHONE_CUE.search(text, max(0, m.start() - 16), m.start()):
                continue
            if digits.isdigit() and kind == "card" and len(digits) != 16 and _luhn(digits[:-1]) != int(digits[-1]):
                continue
            if digits.isascii():
                found.append((m.start(), m.end(), kind))
    if any(title in text for title in TITLES):
        names, roles = [], {}
        for m in _NAME.finditer(text):
            words = []
            for word in _WORD.finditer(text, m.start(1), m.end(1)):
                if not word.group()[0].isupper():
                    break
                owns = _OWNS.search(word.group())
                words.append((word.start(), word.end() - (len(owns.group()) if owns else 0)))
                if owns:
                    break
            if words:
                names.append((words[0][0], words[-1][1], "name"))
                for at, (start, end) in enumerate(words):
                    role = "given" if at == 0 and len(words) > 1 else "name"
                    for part in _lower(text[start:end]).split("-"):
                        if len(part) > 1 and roles.get(part) != "name":
                            roles[part] = role
        found += names + _mentions(text, names, roles)
    found.sort()
    out: list[tuple[int, int, str]] = []
    first, reach = 0, 0
    for at, entity in enumerate(found):
        if entity[0] >= reach:
            out += _apart(found[first:at])
            first = at
        reach = max(reach, entity[1])
    return out + _apart(found[first:])


def _mentions(text: str, names: list[tuple[int, int, str]], roles: dict[str, str]) -> list[tuple[int, int, str]]:
    """Where else the words of ``names`` stand, capitalised: whole, with a genitive s, or as a
    part of a word with hyphens. Words the text also has in lower case are left alone."""
    if not roles:
        return []
    seen, common, inside = [], set(), 0
    for m in _WORD.finditer(text):
        while inside < len(names) and names[inside][1] <= m.start():
            inside += 1
        if inside < len(names) and names[inside][0] <= m.start():
            continue
        word = _OWNS.sub("", m.group())
        for part in re.finditer("[^-]+", word):
            if (plain := _lower(part.group())) in roles:
                if part.group()[0].isupper():
                    seen.append((m.start() + part.start(), m.start() + part.end(), plain))
                else:
                    common.add(plain)
    return [(start, end, roles[plain]) for start, end, plain in seen if plain not in common]


def _apart(chain: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of a chain of overlapping entities those that stay, by place. What is kept has no
    overlaps, so only the two neighbours of a place can meet it."""
    kept: list[tuple[int, int, str]] = []
    for entity in sorted(chain, key=lambda e: (e[0] - e[1], e[0])) if len(chain) > 1 else chain:
        at = bisect(kept, entity)
        if (not at or kept[at - 1][1] <= entity[0]) and (at == len(kept) or entity[1] <= kept[at][0]):
            kept.insert(at, entity)
    return kept


def rewrite(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and (start, end, kind, identity, surrogate) in it as it was."""
    out, last, rows = [], 0, []
    for start, end, kind in entities(text):
        identity, new = surrogate(kind, text[start:end], key)
        out += [text[last:start], new]
        rows.append((start, end, kind, identity, new))
        last = end
    return "".join([*out, text[last:]]), rows


def _epoch(key: bytes, epoch: int) -> bytes:
    return hashlib.blake2b(key, person=b"epoch%d" % epoch, digest_size=32).digest()


def collisions(docs: DataFrame, text: str = "text", key: bytes = KEY, epoch: int = 0) -> DataFrame:
    """(kind, surrogate, entities): surrogates that stand for more than one entity, over all
    texts. Entities are told apart by a hash of what identifies them."""
    keyed = _epoch(key, epoch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for body in batch.column(0).to_pylist():
                for _, _, kind, identity, _ in rewrite(body or "", keyed)[1]:
                    plain = surrogate(kind, identity, keyed)[1]
                    rows.add((kind, hashlib.blake2b(identity.encode(), digest_size=16).digest(), plain))
            columns = list(zip(*sorted(rows))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.string())],
                names=["kind", "entity", "surrogate"])

    return (docs.select(text).mapInArrow(run, "kind string, entity binary, surrogate string").distinct()
            .groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("entities"))
            .where(F.col("entities") > 1))


def replace_entities(docs: DataFrame, text: str = "text", key: bytes = KEY, epoch: int = 0,
                     out: str = "entities") -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``out``: (kind, start, end, surrogate) by place in
    the given text. Null texts stay null, all other columns stay; n_chars, where
    present, is set anew for texts that changed."""
    keyed = _epoch(key, epoch)
    kind = pa.struct([("text", pa.string()), ("entities", pa.list_(pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())])))])

    @F.arrow_udf("text string, entities array<struct<kind:string,start:long,end:long,surrogate:string>>")
    def run(texts: pa.Array) -> pa.Array:
        done = [(None, []) if t is None else rewrite(t, keyed) for t in texts.to_pylist()]
        return pa.array([{"text": new, "entities": [
            {"kind": k, "start": a, "end": b, "surrogate": s} for a, b, k, _, s in rows]}
            for new, rows in done], kind)

    new = docs.withColumn("__new", run(F.col(text)))
    changed = {text: F.col("__new.text"), out: F.col("__new.entities")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("__new.entities") > 0, F.length("__new.text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return new.withColumns(changed).drop("__new")


def replace_checked(docs: DataFrame, text: str = "text", key: bytes = KEY, epochs: int = 8,
                    out: str = "entities") -> DataFrame:
    """``replace_entities`` with the first key epoch under which no two entities of all texts
    share a surrogate."""
    for epoch in range(epochs):
        if collisions(docs, text, key, epoch).isEmpty():
            return replace_entities(docs, text, key, epoch, out)
    raise ValueError("entities share surrogates under every key epoch")
