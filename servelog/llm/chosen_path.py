"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Sets that are equal are one class. Each
class has minwise values of its set; in each of several independent trees a node
branches its members by the values of few seeded coordinates, so similar sets keep
meeting and dissimilar ones part. Small nodes are compared exhaustively: first by
their minwise values, then, what is left, on the full sets. A pair that a node has
already connected is not compared again, so near copies cost one comparison each.

A node that is still large after branching holds sets that are alike. It is compared
with one member, its pivot, on the full sets. Jaccard distance is a metric, so members
linked with the pivot can only be linked with an unlinked member if the distances to
the pivot say so; only these and the unlinked ones branch on. Large groups of near
copies end there in one step, and no pairs of them are ever listed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servelog.llm.components import components
from servelog.llm.wordhash import blocks, hashed_words, mix, shingle_hashes
from servelog.session import cut

SHINGLE = 5
PERCENT = 85  # links: 100 * intersection >= PERCENT * union
TREES = 10
COORDINATES = 96
# Of pairs at the threshold that share a large node in every tree, at most this part may part
MISS = 1e-4
LEVELS = 3  # in so many levels of branching.
MOST_STEPS = 12
LEAF = 2048  # members, and
LEAF_SHINGLES = 2_000_000  # shingles of all members, that one task compares
_draw = np.random.default_rng(20_240_501)
_TREE_A = _draw.integers(0, 1 << 63, TREES, "uint64") * np.uint64(2) + np.uint64(1)
_TREE_B = _draw.integers(0, 1 << 63, TREES, "uint64")
_A = _draw.integers(0, 1 << 31, COORDINATES, "uint32") * np.uint32(2) + np.uint32(1)
_B = _draw.integers(0, 1 << 32, COORDINATES, "uint32")


def shingle_sets(bodies: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; with fewer words than ``size`` the whole
    sequence is one shingle, without words the set is empty."""
    for part in blocks([len(b) for b in bodies]):
        words, _, counts = hashed_words(bodies[part])
        for own in np.split(words, np.cumsum(counts)[:-1]):
            yield np.unique(shingle_hashes(own, size))


def minwise(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minwise values of a set: 64 bits per tree, 16 bits per coordinate."""
    trees, marks = np.full(TREES, ~np.uint64(0), "uint64"), np.full(COORDINATES, ~np.uint32(0), "uint32")
    high = (members >> np.uint64(32)).astype("uint32")
    for at in range(0, len(members), 4096):
        np.minimum(trees, (members[at:at + 4096, None] * _TREE_A + _TREE_B).min(axis=0), out=trees)
        np.minimum(marks, (high[at:at + 4096, None] * _A + _B).min(axis=0), out=marks)
    return trees, (marks >> np.uint32(16)).astype("<u2")


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    return 100 * (both := common(a, b)) >= percent * (len(a) + len(b) - both)


def common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _describe(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            out: list[list] = [[], [], [], []]
            for members in shingle_sets(bodies, size):
                trees, marks = minwise(members)
                full = len(members) > 0
                out[0].append(len(members))
                out[1].append(hashlib.md5(members.tobytes()).digest() if full else None)
                out[2].append(trees.view("int64").tolist() if full else None)
                out[3].append(marks.tobytes() if full else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()),
                 pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())],
                names=["doc_id", "text_hash", "n", "cls", "least", "sketch"])
    return run


def _sets(size: int) -> Callable:
    """(cls, text) -> (cls, members), where the text still gives that class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            bodies = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = [(c, raw) for c, s in zip(wanted, shingle_sets(bodies, size))
                    if hashlib.md5(raw := s.tobytes()).digest() == c]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                names=["cls", "members"])
    return run


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[list]]]:
    """Runs of equal first column in a sorted partition: (key, values of the other columns)."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys, first = columns[0], 0
        while first < len(keys):
            last = first
            while last < len(keys) and keys[last] == keys[first]:
                last += 1
            if held is not None and keys[first] == key:
                for mine, more in zip(held, columns[1:]):
                    mine.extend(more[first:last])
            else:
                if held is not None:
                    yield key, held
                key, held = keys[first], [c[first:last] for c in columns[1:]]
            first = last
    if held is not None:
        yield key, held


def _by_node(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Nodes are bounded by ``LEAF`` members here; the tasks see each whole, in order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, "node").sortWithinPartitions("node")
            .mapInArrow(run, schema))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def least_agreeing(percent: int) -> int:
    """Fewer agreeing coordinates are over six standard deviations from ``percent`` of them."""
    share = percent / 100
    return math.floor(COORDINATES * share - 6 * math.sqrt(COORDINATES * share * (1 - share)))


def _likely(sketches: list[bytes], sizes: list[int], percent: int) -> np.ndarray:
    """Pairs (a, b) of a node that can be linked by size and by their minwise values, those
    that agree most first."""
    marks, sizes = np.frombuffer(b"".join(sketches), "<u2").reshape(len(sketches), -1), np.array(sizes)
    pairs, agree, least = [np.zeros((0, 2), "int64")], [np.zeros(0, "int64")], least_agreeing(percent)
    for at in range(0, len(marks), 64):
        mine = slice(at, at + 64)
        agreeing = (marks[mine, None, :] == marks[None, at:, :]).sum(2, dtype="uint8")
        small = np.minimum.outer(sizes[mine], sizes[at:])
        large = np.maximum.outer(sizes[mine], sizes[at:])
        i, j = np.nonzero(np.triu((agreeing >= least) & (100 * small >= percent * large), 1))
        pairs.append(np.stack([i, j], 1) + at)
        agree.append(agreeing[i, j].astype("int64"))
    return np.concatenate(pairs)[np.argsort(-np.concatenate(agree), kind="stable")]


def _prune(percent: int) -> Callable:
    """node, cls, n, sketch -> node, cls: groups of members that may be linked."""
    def run(batches):
        out: list[tuple[int, bytes]] = []
        for node, (classes, sizes, sketches) in grouped(batches):
            pairs = _likely(sketches, sizes, percent)
            if not len(pairs):
                continue
            forest = _Forest(len(classes))
            for a, b in pairs.tolist():
                forest.join(a, b)
            seed = np.array([node], "int64").view("uint64")
            for member in np.unique(pairs).tolist():
                part = mix(seed + np.uint64(forest.root(member))).view("int64")
                out.append((int(part[0]), classes[member]))
            if len(out) > 20_000:
                yield _two(out, pa.int64(), ["node", "cls"])
                out = []
        yield _two(out, pa.int64(), ["node", "cls"])
    return run


def _two(rows, kind, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.binary())], names=names)


def _compare(percent: int) -> Callable:
    """node, cls, n, sketch, members -> edges (a, b) that connect what links on full sets
    connect. A pair that is already connected inside the node is skipped."""
    def run(batches):
        out: list[tuple[bytes, bytes]] = []
        for _, (classes, sizes, sketches, members) in grouped(batches):
            sets, forest = [np.frombuffer(m, "uint64") for m in members], _Forest(len(classes))
            for a, b in _likely(sketches, sizes, percent).tolist():
                if forest.root(a) != forest.root(b) and linked(sets[a], sets[b], percent):
                    forest.join(a, b)
            # A star per group: all that the components need.
            out += [(classes[m], classes[r]) for m in range(len(classes)) if (r := forest.root(m)) != m]
            if len(out) > 20_000:
                yield _two(out, pa.binary(), ["a", "b"])
                out = []
        yield _two(out, pa.binary(), ["a", "b"])
    return run


def _overlaps(batches):
    """node, cls, pivot, members, others -> cls, pivot, common, total."""
    for batch in batches:
        mine, theirs = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        sets = [(np.frombuffer(m, "uint64"), np.frombuffer(t, "uint64")) for m, t in zip(mine, theirs)]
        both = [common(a, b) for a, b in sets]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:3], pa.array(both, pa.int64()),
             pa.array([len(a) + len(b) - c for (a, b), c in zip(sets, both)], pa.int64())],
            names=["cls", "pivot", "common", "total"])


def missed(percent: int, steps: int, paths: int, levels: int = LEVELS) -> float:
    """The part of pairs at the threshold that no tree keeps together over ``levels`` with these
    steps and paths. How many coordinates agree is binomial and one number for all trees."""
    agree, share = np.arange(COORDINATES + 1), percent / 100
    weight = np.array([math.comb(COORDINATES, k) * share ** k * (1 - share) ** (COORDINATES - k) for k in agree.tolist()])
    meet, lost = (agree / COORDINATES) ** steps, np.zeros(COORDINATES + 1)
    for _ in range(levels):
        lost = (1 - meet * (1 - lost)) ** paths
    return float(weight @ lost ** TREES)


@lru_cache(maxsize=None)
def paths_of(percent: int, steps: int) -> int:
    """The fewest paths by which a node takes ``steps`` that miss at most ``MISS``."""
    paths = math.ceil((100 / percent) ** steps - 1e-9)
    while missed(percent, steps, paths) > MISS:
        paths += 1
    return paths


def _children(percent: int, leaf: int) -> Callable:
    """node, size, cls, sketch -> node, cls: members under their values of ``k`` coordinates that
    the node chose. It chooses so many such paths that pairs at the threshold keep meeting
    over several levels, see ``MISS``; larger nodes take more steps at once."""
    def run(batches):
        for batch in batches:
            nodes = np.array(batch.column(0).to_pylist(), "int64").view("uint64")
            classes = batch.column(2).to_pylist()
            if not len(nodes):
                continue
            size = np.array(batch.column(1).to_pylist(), "float64")
            steps = np.clip(np.ceil(np.log2(4 * size / leaf)), 1, MOST_STEPS).astype("int64")
            paths = np.array([0] + [paths_of(percent, k) for k in range(1, MOST_STEPS + 1)])[steps]
            marks = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(len(nodes), -1)
            out: list[tuple[int, bytes]] = []
            for path in range(int(paths.max())):
                rows = np.flatnonzero(paths > path)
                child = mix(nodes[rows] + np.uint64(path + 1))
                for step in range(int(steps[rows].max())):
                    on = steps[rows] > step
                    column = mix(nodes[rows] ^ np.uint64(1_000_003 * (path * 16 + step + 1))) % np.uint64(COORDINATES)
                    value = marks[rows, column.astype("int64")].astype("uint64")
                    child = np.where(on, mix(child * np.uint64(31) + value), child)
                out += zip(child.view("int64").tolist(), [classes[i] for i in rows.tolist()])
            yield _two(out, pa.int64(), ["node", "cls"])
    return run


def _alive(members: DataFrame) -> DataFrame:
    """Members (node, cls, n) of nodes that hold two or more, with ``size`` and ``weight`` (shingles);
    of nodes with the same members one. Counts are made map-side, rows meet them in a
    join that can be split."""
    nodes = (members.groupBy("node").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("cls")).alias("__x"),
        F.bit_xor(F.xxhash64(F.lit(7), F.col("cls"))).alias("__y")).where(F.col("size") > 1))
    nodes = nodes.groupBy("size", "weight", "__x", "__y").agg(F.min("node").alias("node"))
    return members.join(nodes.select("node", "size", "weight"), "node")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                    percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept, and a hash of its text.

    ``component_id`` is the least doc_id reachable over links, ``kept`` marks that document.
    Null and wordless texts have no shingles and are linked with nothing. Rows that
    repeat a doc_id are documents of their own; a null doc_id is never a component's id
    unless all of it are null, and is kept then. ``percent`` must be at least 75.
    """
    return _linked(docs, text, doc_id, shingle, percent, leaf).drop("root")


def _linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
            percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """``near_duplicates`` with ``root``, the component itself: the least class of equal sets in
    it, null without words. Unlike ``component_id`` it tells unlike texts of one doc_id apart."""
    if percent < 75:
        raise ValueError("the minwise comparison is set for thresholds of 75 % and more")
    base = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                           F.xxhash64(text).alias("text_hash"))
               .mapInArrow(_describe(shingle), "doc_id long, text_hash long, n long, cls binary, "
                                               "least array<long>, sketch binary"))
    classes = cut(base.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("least").alias("least"),
        F.first("sketch").alias("sketch")))
    facts = classes.select("cls", "n", "sketch")
    # Coordinate t of tree t; the tree is part of the key.
    live = cut(_alive(classes.select("cls", "n", F.posexplode("least").alias("tree", "value")).select(
        F.xxhash64("tree", "value").alias("node"), "cls", "n")))
    texts = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("text"))
    sets: list[DataFrame] = []

    def sets_of(keys: DataFrame) -> DataFrame:
        """Full sets of classes; those of earlier calls are not made again."""
        keys = keys.select("cls").distinct()
        for known in sets:
            keys = keys.join(known, "cls", "left_anti")
        wanted = classes.select("cls", "rep").join(keys, "cls", "left_semi")
        rows = wanted.join(texts, wanted["rep"].eqNullSafe(texts["__id"])).select("cls", "text")
        sets.append(cut(rows.mapInArrow(_sets(shingle), "cls binary, members binary").dropDuplicates(["cls"])))
        return _union(sets)

    small = (F.col("size") <= leaf) & (F.col("weight") <= LEAF_SHINGLES)
    edges, leaves, level = [], [live.where(small).select("node", "cls")], 0
    large = live.where(~small)
    while not large.isEmpty():
        rest = large.select("node", "size", "cls")
        if level:
            more, rest = _meet_pivots(rest, sets_of(rest), percent)
            edges.append(more)
        split = rest.join(facts, "cls").select("node", "size", "cls", "sketch")
        children = cut(split.mapInArrow(_children(percent, leaf), "node long, cls binary"))
        live = cut(_alive(children.join(facts.select("cls", "n"), "cls")))
        leaves.append(live.where(small).select("node", "cls"))
        large, level = live.where(~small), level + 1
    members = _union(leaves).join(facts, "cls").select("node", "cls", "n", "sketch")
    likely = cut(_by_node(members, _prune(percent), "node long, cls binary"))
    likely = cut(_alive(likely.join(facts, "cls"))).select("node", "cls", "n", "sketch")
    full = likely.join(sets_of(likely), "cls").select("node", "cls", "n", "sketch", "members")
    edges.append(_by_node(full, _compare(percent), "a binary, b binary"))
    links = _union(edges)
    roots_of = components(links, "a", "b")
    named = classes.select("cls", "rep").join(
        roots_of.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = named.join(least, "root").select("cls", "root", "component_id")
    final = base.select("doc_id", "n", "cls", "text_hash").join(placed, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return final.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "root")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, of rows that share it
    the one with the least text hash. Unlike texts that share a doc_id are in components of
    their own, so each stays; of equal rows without words one does. Texts are moved once, to
    meet the rows that stay."""
    alone = F.when(F.col("n_shingles") == 0, F.struct("doc_id", "text_hash"))
    stay = (_linked(docs, text, doc_id, **settings).where("kept")
            .withColumn("__group", F.struct("root", alone.alias("alone")))
            .groupBy("__group").agg(F.min("doc_id").alias("__id"), F.min("text_hash").alias("__hash"))
            .select(F.coalesce("__id", F.lit(0)).alias("__id"), F.col("__id").isNull().alias("__none"), "__hash"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)),
                              "__none": F.col(doc_id).isNull(), "__hash": F.xxhash64(text)})
    keys = ["__id", "__none", "__hash"]
    return keyed.join(stay, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


def _meet_pivots(large: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links with the pivots, members that branch on) of large nodes."""
    pivots = large.groupBy("node").agg(F.min("cls").alias("pivot"))
    rows = cut(large.join(pivots, "node").where(F.col("cls") != F.col("pivot")))
    pairs = rows.select("cls", "pivot").distinct().withColumn("node", F.lit(0).cast("long"))
    others = sets.select(F.col("cls").alias("pivot"), F.col("members").alias("others"))
    met = cut(pairs.join(sets, "cls").join(others, "pivot")
              .select("node", "cls", "pivot", "members", "others")
              .mapInArrow(_overlaps, "cls binary, pivot binary, common long, total long"))
    is_link: Column = 100 * F.col("common") >= percent * F.col("total")
    rows = rows.join(met, ["cls", "pivot"]).select(
        "node", "size", "cls", "pivot", is_link.alias("near"), (1 - F.col("common") / F.col("total")).alias("d"))
    rows = cut(rows)
    nearest = rows.where(~F.col("near")).groupBy("node").agg(F.min("d").alias("__d"))
    margin = 1 - percent / 100 + 1e-9
    rest = rows.join(nearest, "node").where(~F.col("near") | (F.col("d") >= F.col("__d") - margin))
    return (met.where(is_link).select(F.col("cls").alias("a"), F.col("pivot").alias("b")),
            rest.select("node", "size", "cls"))
