"""Exact cosine near-duplicate join of embeddings by a subspace pigeonhole.

Unit vectors with cosine ``c`` lie within squared distance ``2 - 2c``. After a seeded
rotation they are cut into low-dimensional blocks; a pair that is near overall is
within its share of the squared distance (in proportion to the block's dimensions) in
some block. Each block is a range join: vectors meet by grid cells of a block's first
coordinates and are compared on the whole block; what is left is verified with the
cosine of the given components in double precision. A pair found by several blocks
counts in the first.

Vectors with equal components are one class. Cells are dealt into tiles of bounded
size, and a tile returns sums and a spanning set of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelog.llm.chosen_path import _Forest, grouped
from servelog.llm.components import components
from servelog.session import cut

COSINE = 0.98
BLOCK_DIMS = 16
GRID_DIMS = 2
TILE = 1024
_SLACK = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    draw = np.random.default_rng(97 + dims).standard_normal((dims, dims))
    q, r = np.linalg.qr(draw)
    return q * np.sign(np.diag(r))


def block_bounds(dims: int, block_dims: int) -> list[tuple[int, int]]:
    n = max(1, dims // block_dims)
    return [(dims * b // n, dims * (b + 1) // n) for b in range(n)]


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Rotated unit vectors. Summed coordinate by coordinate, so a row does not depend on
    the rows beside it."""
    unit, turn = vectors / norms(vectors)[:, None], rotation(vectors.shape[1])
    out = np.zeros_like(unit)
    for j in range(unit.shape[1]):
        out += unit[:, j:j + 1] * turn[j]
    return out


def norms(vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total += vectors[:, j] ** 2
    return np.sqrt(total)


def _stack(raw: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype("<f8")


def _pack(column: pa.Array, dtype: str) -> list[bytes | None]:
    """Components as bytes, None for vectors that link with nothing."""
    out = []
    for row in column.to_pylist():
        ok = bool(row) and None not in row
        vector = np.array(row, dtype) + np.zeros(1, dtype) if ok else None  # no negative zero
        if ok:
            size = float(norms(vector.astype("<f8")[None])[0])
            ok = bool(np.isfinite(vector).all()) and 0 < size < np.inf
        out.append(vector.tobytes() if ok else None)
    return out


def _packed(dtype: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(_pack(batch.column(2), dtype), pa.binary())],
                names=["vec_id", "label", "vec"])
    return run


def _cells(cosine: float, block_dims: int, grid_dims: int, dtype: str) -> Callable:
    """(cls, label, weight, vec) -> rows (key parts, home, cls, weight, vec): one home cell per
    block, and the other cells that the block's range reaches."""
    def run(batches):
        for batch in batches:
            classes, labels, weights, raw = (c.to_pylist() for c in batch.columns)
            by_dims: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                by_dims.setdefault(len(v) // int(dtype[-1]), []).append(i)
            for dims, rows in by_dims.items():
                place = rotated(_stack([raw[i] for i in rows], dtype))
                for block, (first, last) in enumerate(block_bounds(dims, block_dims)):
                    reach = np.sqrt((2 - 2 * cosine) * (last - first) / dims) + _SLACK
                    at = place[:, first:min(last, first + grid_dims)] / (2 * reach)
                    home = np.floor(at).astype("int64")
                    aside = np.where(at - home < 0.5, -1, 1)
                    for step in np.ndindex(*[2] * at.shape[1]):
                        cell = home + aside * np.array(step)
                        key = [f"{dims}:{block}:" + ":".join(map(str, c)) for c in cell.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([labels[i] for i in rows], batch.column(1).type), pa.array(key),
                             pa.array([not any(step)] * len(rows)), pa.array([classes[i] for i in rows], pa.int64()),
                             pa.array([weights[i] for i in rows], pa.int64()),
                             pa.array([raw[i] for i in rows], pa.binary())],
                            names=["label", "cell", "home", "cls", "weight", "vec"])
    return run


def _join(cosine: float, block_dims: int, dtype: str) -> Callable:
    """Sorted tiles (tile, block, row, cls, weight, vec) -> (cls, links, root): the tile's row
    side against its column side."""
    def run(batches):
        for _, (block, row, cls, weight, raw) in grouped(batches):
            rows, cols = np.flatnonzero(row), np.flatnonzero(~np.array(row))
            if not len(rows) or not len(cols):
                continue
            cls, weight, vectors = np.array(cls), np.array(weight), _stack(raw, dtype)
            place, length = rotated(vectors), norms(vectors)
            dims, block = vectors.shape[1], block[0]
            bounds = block_bounds(dims, block_dims)
            budget = [(2 - 2 * cosine) * (b - a) / dims + _SLACK for a, b in bounds]
            part = place[:, slice(*bounds[block])]
            square = (part ** 2).sum(1)
            links, forest = np.zeros(len(cls)), _Forest(len(cls))
            copies: dict[int, int] = {}
            for at, c in enumerate(cls.tolist()):  # a class may stand on both sides
                forest.join(copies.setdefault(c, at), at)
            for at in range(0, len(rows), 256):
                mine = rows[at:at + 256]
                apart = square[mine][:, None] + square[cols] - 2 * part[mine] @ part[cols].T
                i, j = np.nonzero((apart <= budget[block] + 1e-8) & (cls[mine][:, None] < cls[cols]))
                for lo in range(0, len(i), 16_384):
                    p, q = mine[i[lo:lo + 16_384]], cols[j[lo:lo + 16_384]]
                    gaps = (place[p] - place[q]) ** 2
                    ok = np.ones(len(p), bool)
                    for k, (x, y) in enumerate(bounds[:block + 1]):
                        within = _in_order(gaps[:, x:y]) <= budget[k]
                        ok &= within if k == block else ~within
                    ok &= _in_order(vectors[p] * vectors[q]) / (length[p] * length[q]) >= cosine
                    p, q = p[ok], q[ok]
                    links += np.bincount(p, weight[q], len(cls)) + np.bincount(q, weight[p], len(cls))
                    for x, y in zip(p.tolist(), q.tolist()):
                        forest.join(x, y)
            hit = np.flatnonzero(links)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[hit]), pa.array(links[hit].astype("int64")),
                     pa.array([int(cls[forest.root(h)]) for h in hit.tolist()], pa.int64())],
                    names=["cls", "links", "root"])
    return run


def _in_order(terms: np.ndarray) -> np.ndarray:
    total = np.zeros(len(terms))
    for j in range(terms.shape[1]):
        total += terms[:, j]
    return total


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                 label: str = "label", cosine: float = COSINE, block_dims: int = BLOCK_DIMS,
                 grid_dims: int = GRID_DIMS, tile: int = TILE) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    Only vectors of one label that is not null are compared. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do vectors of
    different dimensions. Rows that repeat a vec_id are vectors of their own; those with
    equal components link with each other. A null vec_id is no component's id unless
    all of it are null.
    """
    kind = vectors.schema[label].dataType.simpleString()
    dtype = "<f4" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"
    rows = cut(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
                              F.col(embedding).alias("embedding"))
               .mapInArrow(_packed(dtype), f"vec_id long, label {kind}, vec binary")
               .withColumn("vec", F.when(F.col("label").isNotNull(), F.col("vec")))
               .withColumn("key", F.sha2(F.col("vec"), 256)))
    classes = cut(rows.where(F.col("vec").isNotNull()).groupBy("label", "key").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("rep"), F.first("vec").alias("vec"))
        .withColumn("cls", F.xxhash64("label", "key")))
    cells = cut(classes.select("cls", "label", "weight", "vec").mapInArrow(
        _cells(cosine, block_dims, grid_dims, dtype),
        f"label {kind}, cell string, home boolean, cls long, weight long, vec binary"))
    held = cells.groupBy("label", "cell").agg(
        F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("all")).where(
        (F.col("homes") > 0) & (F.col("all") > 1))
    # Home vectors in row tiles, all of the cell in column tiles; each tile meets each.
    dealt = cells.join(held, ["label", "cell"])
    n_rows, n_cols = F.ceil(F.col("homes") / tile), F.ceil(F.col("all") / tile)
    spread = F.pmod(F.xxhash64("cls"), F.lit(1 << 40))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_row = dealt.where("home").select(
        "*", (spread % n_rows).alias("r"), F.explode(every(n_cols)).alias("c"), F.lit(True).alias("row"))
    as_col = dealt.select(
        "*", F.explode(every(n_rows)).alias("r"), (spread % n_cols).alias("c"), F.lit(False).alias("row"))
    met = as_row.unionByName(as_col).select(
        F.concat_ws("/", F.col("label").cast("string"), "cell", F.col("r").cast("string"),
                    F.col("c").cast("string")).alias("tile"),
        F.split("cell", ":")[1].cast("int").alias("block"), "row", "cls", "weight", "vec")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(met.repartition(parts, "tile").sortWithinPartitions("tile")
                .mapInArrow(_join(cosine, block_dims, dtype), "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select("cls", "root"), "cls", "root").withColumnRenamed("node", "cls")
    named = (classes.select("label", "key", "cls", "weight", "rep").join(links, "cls", "left")
             .join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = named.join(least, "root").select(
        F.col("label").alias("__label"), F.col("key").alias("__key"), "component_id",
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "label", "key").join(
        placed, (F.col("label") == F.col("__label")) & (F.col("key") == F.col("__key")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
