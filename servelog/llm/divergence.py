"""Source divergence audit: how far sources of one language differ in their words.

Each language keeps the terms found in enough of its documents. A kept term is a row of
counts by source. The divergence of two sources sums over all kept terms, of which most are
missing from one source or both. With g(c, d) the term's share for counts c and d,

    sum g = terms * g(0,0) + sum [g(c,0) - g(0,0)] + sum [g(0,d) - g(0,0)]
            + sum [g(c,d) - g(c,0) - g(0,d) + g(0,0)]

where the first two sums need each count of one source alone and the last one only terms that
both have. For the last one the rows, nonzero counts ordered by source, go into a
frequent-pattern tree: rows that start alike share a path, a node knows how many terms
pass through it, and each node meets each of its ancestors once, however many terms that
is. A sorted range of rows is one tree; a node cut by the end of a range counts in parts.

Smoothed shares are p = 1 + floor(10^9 (count + 2) / (N + 2 V)), all arithmetic is exact.
Null text, lang and source are ''; every row is a document of its own; a source without
kept terms still meets all others of its language, with value 0 if the language
keeps no term. No row of more entries than a language has sources is ever formed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelog.session import cut

LEAST_DOCS = 10
TOP_TERMS = 10
#: Entries (nonzero counts) of one tree, node-ancestor pairs at once, counted terms held by a task.
TREE_ENTRIES = 1_000_000
PAIRS_AT_ONCE = 500_000
HELD_TERMS = 200_000
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                      ("n", pa.int64()), ("docs", pa.int64())])
_NODES = pa.schema([("lang", pa.string()), ("hi", pa.int32()), ("lo", pa.int32()),
                    ("p", pa.int64()), ("value", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term); a row without term per group."""
    n: dict = {}
    docs: dict = {}

    def rows():
        held = [(*group, term, n[group][term], k) for group, terms in docs.items() for term, k in terms.items()]
        held += [(*group, None, 0, 0) for group in docs]
        n.clear()
        docs.clear()
        columns = list(zip(*held))
        columns[2] = [t if t is None else t.decode() for t in columns[2]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED)], schema=_COUNTED)

    held = 0
    for batch in batches:
        bodies = batch.column(0).cast(pa.binary()).to_pylist()
        for body, lang, source in zip(bodies, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            terms = (body or b"").translate(_TERM_BYTES).split()
            group = (lang or "", source or "")
            all_, each = n.setdefault(group, Counter()), docs.setdefault(group, Counter())
            held -= len(each)
            all_.update(terms)
            each.update(set(terms))
            held += len(each)
            if held > HELD_TERMS:
                yield rows()
                held = 0
    if docs:
        yield rows()


def share(count: Column, whole: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (whole + 2 terms)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(count) + F.lit(2)) * F.lit(1_000_000_000),
                           F.greatest(F.lit(1).cast("decimal(20,0)"), wide(whole + 2 * terms))) + F.lit(1)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))"""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tree(lang: str, rank: np.ndarray, p: np.ndarray, zero: np.ndarray, starts: np.ndarray,
          times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nodes of the tree of some sorted rows (row r has entries ``starts[r]`` to ``starts[r + 1]``
    and stands for ``times[r]`` terms), then the corrections of nodes with their ancestors."""
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    depth = np.arange(len(row)) - starts[row]
    before = np.maximum(row - 1, 0)
    held = (row > 0) & (depth < lengths[before])
    twin = np.where(held, starts[before] + depth, 0)
    unlike = ~(held & (rank == rank[twin]) & (p == p[twin]))
    sums = np.cumsum(unlike)
    first = starts[row]
    new = sums - sums[first] + unlike[first] > 0  # unlike the row before here or higher up
    order = np.argsort(depth, kind="stable")
    node = np.cumsum(new[order]) - 1  # rows of a node follow each other at their depth
    through = np.bincount(node, times[row[order]]).astype("int64")
    at = order[new[order]]
    yield _nodes(lang, rank[at], None, p[at], through)
    deep = depth[at] > 0
    at, through = at[deep], through[deep]
    lo = 0
    ends = np.cumsum(depth[at])
    while lo < len(at):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
        mine, many = at[lo:hi], depth[at[lo:hi]]
        below = np.repeat(mine, many)
        above = np.arange(len(below)) - np.repeat(np.cumsum(many) - many, many) + starts[row[below]]
        more = _gap(p[below], p[above]) - _gap(p[below], zero[above]) - _gap(zero[below], p[above]) \
            + _gap(zero[below], zero[above])
        pair, back = np.unique(rank[below].astype("int64") << 32 | rank[above], return_inverse=True)
        value = np.zeros(len(pair), "int64")
        np.add.at(value, back.ravel(), more * np.repeat(through[lo:hi], many))
        yield _nodes(lang, pair >> 32, pair & 0xFFFFFFFF, None, value)
        lo = hi


def _nodes(lang, hi, lo, p, value) -> pa.RecordBatch:
    n = len(value)
    columns = [pa.array([lang] * n, pa.string()), pa.array(hi, pa.int32()),
               pa.nulls(n, pa.int32()) if lo is None else pa.array(lo, pa.int32()),
               pa.nulls(n, pa.int64()) if p is None else pa.array(p, pa.int64()), pa.array(value, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=_NODES)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, path, times) sorted by lang and path, as trees of bounded size."""
    held: list = []
    entries, lang = 0, None

    def grow():
        rank, p, zero, lengths, times = (np.concatenate(c) for c in zip(*held))
        starts = np.concatenate([np.zeros(1, "int64"), np.cumsum(lengths)])
        held.clear()
        return _tree(lang, rank, p, zero, starts, times)

    for batch in batches:
        names, paths = batch.column(0), batch.column(1)
        ends = paths.offsets.to_numpy()
        flat = [c.to_numpy(zero_copy_only=False) for c in paths.values.flatten()]
        times = batch.column(2).to_numpy()
        names = names.to_pylist()
        at = 0
        while at < len(names):
            stop = at + 1
            while stop < len(names) and names[stop] == names[at]:
                stop += 1
            if held and (names[at] != lang or entries > TREE_ENTRIES):
                yield from grow()
                entries = 0
            lang = names[at]
            held.append([*[c[ends[at]:ends[stop]] for c in flat], np.diff(ends[at:stop + 1]).astype("int64"),
                         times[at:stop]])
            entries += int(ends[stop] - ends[at])
            at = stop
    if held:
        yield from grow()


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                      least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): in part ``pair`` every other source of the language
    with the divergence from it, in part ``term`` the ``top`` kept terms the source has more
    than its share of. Ranks by value, largest first, then by item.
    """
    counted = (docs.select(F.col(text), F.col(lang), F.col(source))
               .mapInArrow(_count, "lang string, source string, term string, n long, docs long")
               .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    counted = cut(counted)
    kept = cut(counted.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "n")).alias("by"), F.sum("n").alias("whole"),
        F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
    each = kept.select("lang", "term", "whole", F.inline("by"))
    groups = _groups(counted, kept, each)
    occurring = (each.join(groups, ["lang", "source"])
                 .withColumn("p", share(F.col("n"), F.col("group_n"), F.col("terms"))))
    return _terms(occurring, top).union(_pairs(occurring, groups))


def _groups(counted: DataFrame, kept: DataFrame, each: DataFrame) -> DataFrame:
    """A row per (lang, source): its rank, kept words, share of a missing term, and the language's."""
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("whole").alias("lang_n"))
    by_size = Window.partitionBy("lang").orderBy(F.col("group_n").desc(), "source")
    return cut(counted.where(F.col("term").isNull()).select("lang", "source")
               .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
               .na.fill(0, ["group_n", "terms", "lang_n"])
               .withColumn("rank", F.row_number().over(by_size))
               .withColumn("zero", share(F.lit(0), F.col("group_n"), F.col("terms"))))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(best)).select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _terms(occurring: DataFrame, top: int) -> DataFrame:
    q = share(F.col("whole"), F.col("lang_n"), F.col("terms"))
    over = (occurring.where(F.col("n") > 0).withColumn("q", q).where(F.col("p") > F.col("q"))
            .select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")))
    return _ranked(over, "term").where(F.col("rank") <= top)


def _pairs(occurring: DataFrame, groups: DataFrame) -> DataFrame:
    paths = (occurring.groupBy("lang", "term")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "p", "zero"))).alias("path"))
             .groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times")))
    parts = int(occurring.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows that start alike come together; the hash lets a range end within a common start.
    head = [F.col("lang"), F.slice("path", 1, 3), F.xxhash64("path")]
    nodes = cut(paths.repartitionByRange(parts, *head).sortWithinPartitions("lang", "path")
                .select("lang", "path", "times")
                .mapInArrow(_trees, "lang string, hi int, lo int, p long, value long"))
    both = nodes.where(F.col("lo").isNotNull()).select("lang", "lo", "hi", "value")
    one = nodes.where(F.col("lo").isNull()).groupBy("lang", F.col("hi").alias("rank"), "p").agg(
        F.sum("value").alias("times"))
    mine = groups.select("lang", "rank", F.col("zero").alias("own_zero"))
    other = groups.select("lang", F.col("rank").alias("other"), "zero")
    alone = (one.join(mine, ["lang", "rank"]).join(other, "lang").where(F.col("rank") != F.col("other"))
             .select("lang", F.least("rank", "other").alias("lo"), F.greatest("rank", "other").alias("hi"),
                     (F.col("times") * (gap(F.col("p"), F.col("zero")) - gap(F.col("own_zero"), F.col("zero")))).alias("value")))
    left = groups.select("lang", F.col("rank").alias("lo"), F.col("source").alias("a"), F.col("zero").alias("za"), "terms")
    right = groups.select("lang", F.col("rank").alias("hi"), F.col("source").alias("b"), F.col("zero").alias("zb"))
    base = left.join(right, "lang").where(F.col("lo") < F.col("hi")).select(
        "lang", "lo", "hi", (F.col("terms") * gap(F.col("za"), F.col("zb"))).alias("value"), "a", "b")
    nobody = [F.lit(None).cast("string").alias(c) for c in "ab"]
    summed = (base.union(both.select("*", *nobody)).union(alone.select("*", *nobody))
              .groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"), F.max("a").alias("a"), F.max("b").alias("b")))
    way = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    return _ranked(summed.select("lang", F.inline(F.array(way("a", "b"), way("b", "a"))), "value"), "pair")
