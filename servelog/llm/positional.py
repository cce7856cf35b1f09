"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings of every training token: a row per block of documents
with the block's distinct terms, and for each the sorted places where it stands. The index
is a table of its own, built once and searched by any test set. Blocks hold a bounded
number of words; a longer document is cut into segments that overlap by a window.

A search takes the windows of the test items (ten consecutive words, or the whole of a
shorter item) to every block. There a window without one of its terms is dropped;
the others start from the list of their rarest term and intersect it with the
lists of the next rare ones, each shifted by its distance from the window's start. What
is left are the window's exact places, so nothing but the postings is read.

Proximity matches need all distinct terms of a window, in any order, within ``slack`` words
more than it has: places of the rarest term are kept if every other term has one close by,
and the spans around the few that stay are tried one after the other.

Test sets go to the tasks in pieces of about ``PIECE_WORDS`` words, one search of the index each,
so neither the driver nor a task holds more of them at a time. Terms are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelog.llm.wordhash import hashed_words
from servelog.session import cut

WINDOW = 10
BLOCK_WORDS = 200_000
BLOCK_BYTES = 1_500_000
PIECE_WORDS = 200_000
ITEM_WORDS = 20_000  # longer items are searched in overlapping parts
SPAN = 64  # the longest span a search may ask for; long documents are cut with this overlap
_GAP = 2 * SPAN  # free places between documents of a block: no window or proximity span crosses
# Letters, digits and all of non-ASCII are words; A-Z counts as a-z.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))
_INDEX = pa.schema([
    ("block", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())),
    ("origins", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())),
    ("whole", pa.list_(pa.bool_())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
    ("places", pa.list_(pa.int32()))])
_INDEX_DDL = ("block long, rows array<long>, ids array<long>, origins array<long>, lengths array<long>, "
              "words array<long>, whole array<boolean>, terms array<long>, counts array<int>, places array<int>")


def _tokens(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit word hashes of texts in order, and words per text."""
    if len(bodies) == 1 and len(bodies[0]) > BLOCK_BYTES:  # a long text in parts that end with a word
        body, parts, at = bodies[0].translate(_WORDS), [], 0
        while at < len(body):
            end = body.find(b" ", at + BLOCK_BYTES)
            end = len(body) if end < 0 else end
            parts.append(hashed_words([body[at:end]])[0])
            at = end
        words = np.concatenate(parts)
        return words.view("int64"), np.array([len(words)])
    words, _, counts = hashed_words([b.translate(_WORDS) for b in bodies])
    return words.view("int64"), counts


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = (TaskContext.get().partitionId() << 32) - 1
    row = block
    held: list = []  # (row, doc_id, words before the segment, its words, new words, whole)
    size = 0

    def store():
        nonlocal block
        block += 1
        lengths = np.array([len(h[3]) for h in held], "int64")
        starts = np.cumsum(lengths + _GAP) - lengths - _GAP
        words = np.concatenate([h[3] for h in held])
        place = np.arange(len(words)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
        order = np.argsort(words, kind="stable")  # places of a term stay sorted
        terms, counts = np.unique(words, return_counts=True)
        rows, ids, origins, _, new, whole = zip(*held)
        held.clear()
        values = [rows, ids, origins, lengths, new, whole, terms, counts.astype("int32"), place[order].astype("int32")]
        return pa.RecordBatch.from_arrays(
            [pa.array([block])] + [pa.array([v], f.type) for v, f in zip(values, list(_INDEX)[1:])], schema=_INDEX)

    for batch in batches:
        ids = batch.column(0).to_pylist()
        bodies = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
        at = 0
        while at < len(ids):
            stop, held_bytes = at + 1, len(bodies[at])
            while stop < len(ids) and held_bytes + len(bodies[stop]) <= BLOCK_BYTES:
                held_bytes += len(bodies[stop])
                stop += 1
            words, counts = _tokens(bodies[at:stop])
            for doc_id, text in zip(ids[at:stop], np.split(words, np.cumsum(counts)[:-1])):
                row += 1
                whole = len(text) <= BLOCK_WORDS
                for first in range(0, max(1, len(text)), BLOCK_WORDS):
                    part = text[max(0, first - SPAN):first + BLOCK_WORDS]
                    new = min(len(text), first + BLOCK_WORDS) - first
                    if held and size + len(part) > BLOCK_WORDS:
                        yield store()
                        size = 0
                    held.append((row, doc_id, max(0, first - SPAN), part, new, whole))
                    size += len(part) + 100  # a row of its own, too
            at = stop
    if held:
        yield store()


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The stored index: per block its documents (``rows`` are numbers of their own, so a repeated
    or null doc_id is a document like any other) and the postings, ``places`` term by term.
    Null texts have no words.
    """
    return cut(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_indexed, _INDEX_DDL))


@dataclass
class Windows:
    """Distinct windows as rows of term numbers (-1 after the end of a short one)."""
    vocabulary: np.ndarray  # sorted term hashes
    terms: np.ndarray
    items: list[list[str]]  # of each window
    lengths: np.ndarray


def windows_of(rows: list[tuple], size: int) -> Windows:
    """Of (item_id, text) rows; items of no words have none."""
    words, counts = _tokens([(text or "").encode() for _, text in rows])
    items: dict[tuple, set] = {}
    for (item, _), part in zip(rows, np.split(words, np.cumsum(counts)[:-1])):
        part = part.tolist()
        for at in range(max(1, len(part) - size + 1) if part else 0):
            items.setdefault(tuple(part[at:at + size]), set()).add(item)
    vocabulary = np.unique(words)
    lengths = np.array([len(w) for w in items], "int64")
    terms = np.full((len(items), size), -1, "int64")
    if items:
        flat = np.searchsorted(vocabulary, np.array([t for w in items for t in w], "int64"))
        row = np.repeat(np.arange(len(items)), lengths)
        terms[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return Windows(vocabulary, terms, [sorted(i for i in v if i is not None) for v in items.values()], lengths)


class _Postings:
    """One block's lists: ``key`` is (place in the vocabulary, place in the text), sorted."""

    def __init__(self, vocabulary: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray):
        if not len(terms):
            terms, counts = np.zeros(1, "int64"), np.zeros(1, "int64")
        found = np.searchsorted(terms, vocabulary)
        here = (found < len(terms)) & (terms[np.minimum(found, len(terms) - 1)] == vocabulary)
        ends = np.cumsum(counts, dtype="int64")
        self.count = np.where(here, counts[np.minimum(found, len(counts) - 1)], 0).astype("int64")
        self.start = np.cumsum(self.count) - self.count
        from_ = np.where(here, ends[np.minimum(found, len(ends) - 1)] - self.count, 0)
        take = np.arange(int(self.count.sum())) + np.repeat(from_ - self.start, self.count)
        self.place = places[take].astype("int64")
        self.key = np.repeat(np.arange(len(vocabulary)) << 32, self.count) + self.place

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of each of ``terms``, and whose they are."""
        many = self.count[terms]
        owner = np.repeat(np.arange(len(terms)), many)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + self.start[terms][owner]
        return self.place[at], owner

    def next(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first place of each term at or after a place; far away if there is none."""
        if not len(self.key):
            return np.full(len(terms), 1 << 40)
        want = (terms << 32) + np.maximum(places, 0)
        at = np.searchsorted(self.key, want)
        got = self.key[np.minimum(at, len(self.key) - 1)]
        return np.where((at < len(self.key)) & (got >> 32 == terms), got & 0xFFFFFFFF, 1 << 40)


#: Places tried at once, so a window of frequent words takes bounded memory.
_AT_ONCE = 1_000_000


def _chunks(rows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of ``rows`` with ``_AT_ONCE`` places at most (or one row)."""
    part = np.cumsum(sizes) // _AT_ONCE
    for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(part)) + 1):
        if len(at):
            yield rows[at]


def _alive(windows: Windows, post: _Postings) -> tuple[np.ndarray, np.ndarray]:
    """Windows with all terms in the block, and the order of each one's offsets by rarity."""
    size = np.where(windows.terms >= 0, post.count[windows.terms], 1 << 40)
    alive = np.flatnonzero((size > 0).all(1)) if len(windows.terms) else np.zeros(0, "int64")
    return alive, np.argsort(size[alive], axis=1, kind="stable")


def _phrases(windows: Windows, post: _Postings) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its first word) of all exact occurrences."""
    alive, rarity = _alive(windows, post)
    out = [(np.zeros(0, "int64"), np.zeros(0, "int64"))]
    rarest = windows.terms[alive, rarity[:, 0]] if len(alive) else alive
    for rows in _chunks(np.arange(len(alive)), post.count[rarest]):
        place, owner = post.lists(rarest[rows])
        row = rows[owner]
        start = place - rarity[row, 0]
        for k in range(1, windows.terms.shape[1]):
            off = rarity[row, k]
            term = windows.terms[alive[row], off]
            ok = (term < 0) | ((start >= 0) & (post.next(term, start + off) == start + off))
            row, start = row[ok], start[ok]
        out.append((alive[row], start))
    return tuple(np.concatenate(c) for c in zip(*out))


def _close(windows: Windows, post: _Postings, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its rarest term) where all its terms stand within its length and ``slack``."""
    alive, rarity = _alive(windows, post)
    out = [(np.zeros(0, "int64"), np.zeros(0, "int64"))]
    rarest = windows.terms[alive, rarity[:, 0]] if len(alive) else alive
    for rows in _chunks(np.arange(len(alive)), post.count[rarest]):
        place, owner = post.lists(rarest[rows])
        row = rows[owner]
        for k in range(1, windows.terms.shape[1]):
            term, span = windows.terms[alive[row], rarity[row, k]], windows.lengths[alive[row]] + slack
            ok = (term < 0) | (post.next(term, place - span + 1) < place + span)
            row, place = row[ok], place[ok]
        span = windows.lengths[alive[row]] + slack
        for back in range(int(span.max()) if len(span) else 0):  # spans that begin before the rarest term
            start = place - back
            ok = (back < span) & (start >= 0)
            for k in range(1, windows.terms.shape[1]):
                term = windows.terms[alive[row], rarity[row, k]]
                ok &= (term < 0) | (post.next(term, start) < start + span)
            out.append((alive[row[ok]], place[ok]))
    return tuple(np.concatenate(c) for c in zip(*out))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("whole", pa.bool_()),
                    ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string())), ("close", pa.list_(pa.string()))])
_FOUND_DDL = ("row long, doc_id long, n_words long, whole boolean, spans array<struct<start:long,end:long>>, "
              "items array<string>, close array<string>")


def _merged(starts: np.ndarray, lengths: np.ndarray) -> list[dict]:
    """Disjoint spans that cover the same words; ``starts`` are sorted."""
    out: list[dict] = []
    for start, length in zip(starts.tolist(), lengths.tolist()):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], start + length)
        else:
            out.append({"start": start, "end": start + length})
    return out


def _per_document(windows: Windows, window: np.ndarray, doc: np.ndarray) -> dict[int, list[str]]:
    """Sorted items of the windows found in each document."""
    found: dict[int, set] = {}
    for w, d in np.unique(np.stack([window, doc], 1), axis=0).tolist():
        found.setdefault(d, set()).update(windows.items[w])
    return {d: sorted(items) for d, items in found.items()}


def _search(windows: Windows, slack: int | None):
    def found_in(row: dict) -> pa.RecordBatch:
        lengths = row["lengths"]
        starts = np.cumsum(lengths + _GAP) - lengths - _GAP
        document = lambda place: np.searchsorted(starts, place, "right") - 1
        post = _Postings(windows.vocabulary, row["terms"], row["counts"], row["places"])
        window, place = _phrases(windows, post)
        doc = document(place)
        order = np.lexsort((place, doc))
        window, place, doc = window[order], place[order], doc[order]
        items = _per_document(windows, window, doc)
        spans: list[list] = [[] for _ in lengths]
        for d in items:
            mine = slice(*np.searchsorted(doc, [d, d + 1]))
            spans[d] = _merged(place[mine] - starts[d] + row["origins"][d], windows.lengths[window[mine]])
        close: dict[int, list[str]] = {}
        if slack is not None:
            window, place = _close(windows, post, slack)
            close = _per_document(windows, window, document(place))
        n = range(len(lengths))
        columns = [row["rows"], row["ids"], row["words"], row["whole"], spans,
                   [items.get(d, []) for d in n], [close.get(d, []) for d in n]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: column[k].values for name, column in zip(batch.schema.names, batch.columns) if name != "block"}
                yield found_in({n: v if n == "ids" else v.to_numpy(zero_copy_only=False) for n, v in row.items()})
    return run


def _item_parts(size: int):
    """Long items as overlapping parts that have the same windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for item, body in zip(ids, bodies):
                words = (body or b"").translate(_WORDS).split()
                parts = [b" ".join(words[at:at + ITEM_WORDS + size - 1])
                         for at in range(0, max(1, len(words) - size + 1), ITEM_WORDS)]
                n = [min(len(words) - at, ITEM_WORDS + size - 1) for at in range(0, max(1, len(words) - size + 1), ITEM_WORDS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item or ""] * len(parts)), pa.array([p.decode() for p in parts]), pa.array(n, pa.int64())],
                    names=["item", "text", "n"])
    return run


def _pieces(items: DataFrame, text: str, item_id: str, size: int) -> tuple[DataFrame, int]:
    parts = cut(items.select(F.col(item_id).cast("string"), F.col(text))
                .mapInArrow(_item_parts(size), "item string, text string, n long"))
    total = parts.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // PIECE_WORDS))
    return parts.withColumn("piece", F.pmod(F.xxhash64("item", "text"), F.lit(count))), count


def phrase_matches(index: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                   size: int = WINDOW, slack: int | None = None) -> DataFrame:
    """(row, doc_id, n_words, spans, items, close), one row per indexed document.

    ``spans`` are the disjoint runs of words (start, end) inside an occurrence of a window of
    some item, ``items`` the sorted ids of these items. With ``slack``, ``close`` are the sorted
    ids of items with a proximity match, which every phrase match of a document is too; else
    it is empty. Items without words match nothing, a null item_id reads as '', items of one
    id are one item. An empty test set matches nothing.
    """
    parts, count = _pieces(items, text, item_id, size)
    if size + (slack or 0) > SPAN:
        raise ValueError(f"the index finds spans of {SPAN} words at most")
    found = []
    for k in range(count):
        rows = [(r["item"], r["text"]) for r in parts.where(F.col("piece") == k).select("item", "text").collect()]
        one = cut(index.mapInArrow(_search(windows_of(rows, size), slack), _FOUND_DDL))
        if k:  # only what the first piece does not say already
            one = one.where((F.size("items") > 0) | (F.size("close") > 0)).withColumn("n_words", F.lit(0).cast("long"))
        found.append(one)
    single = found[0].where("whole") if count == 1 else found[0].where("false")
    split = found[0].where("not whole") if count == 1 else found[0]
    for one in found[1:]:
        split = split.union(one)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    joined = split.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"),
                                      F.flatten(F.collect_list("spans")).alias("spans"), flat("items"), flat("close"))
    columns = ["row", "doc_id", "n_words", "spans", "items", "close"]
    return single.select(columns).union(joined.withColumn("spans", _joined_spans("spans")).select(columns))


def _joined_spans(spans):
    """Spans of several parts of a document, sorted; those that touch made one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda done: F.element_at(done, -1)
    grown = lambda done, s: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
        last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))))
    return F.aggregate(F.array_sort(spans), none, lambda done, s: F.when(
        F.size(done) == 0, F.array(s)).when(s["start"] <= last(done)["end"], grown(done, s))
        .otherwise(F.concat(done, F.array(s))))
