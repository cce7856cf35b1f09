"""Distinct keys between two accesses of one stream, counted slice by slice.

The number of distinct keys touched strictly between positions p and j of a
stream equals ``j - 1 - p - #{i < j : prev(i) >= p}`` where ``prev(i)`` is the position
of the previous access to the key of i (0 if none) and positions start at 1:
of the accesses in (p, j) those count that are the first to their key after p. First
accesses (``prev`` 0) are never taken off, so only later ones are points of a two-sided
count, which splits over slices of equal position ranges:

* whole slices before j's slice and whole ``prev`` slices from p's slice on:
  a grid of counts, one cell per pair of slices;
* of them, ``prev`` before p in p's own slice: ranked inside p's slice;
* i in j's own slice: ranked inside j's slice.

No pair of rows is ever formed and no block is larger than a slice, because
``prev`` is injective (a slice of ``prev`` values has at most one slice of rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servelog.plans.folds import fold_sorted

# A stream of n accesses has S = n / slice slices and a grid of S * S / 2 cells:
# with 100,000 positions a slice the grid stays smaller than the stream up to
# 2 * 10^10 accesses of one worker. A block, which Python holds whole with some ten
# temporary columns, is 200,000 rows at most, however long the stream.
POSITIONS_PER_SLICE = 100_000


def count_below(values: np.ndarray, upto: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each query, how many of ``values[:upto]`` are smaller than ``limit``."""
    level = values.astype(np.int64)
    limit = limit.astype(np.int64)
    top = int(max(level.max(initial=0), limit.max(initial=0)))
    lo, hi = np.zeros(len(upto), np.int64), upto.astype(np.int64)
    found = np.zeros(len(upto), np.int64)
    for b in range(max(top.bit_length(), 1) - 1, -1, -1):
        bit = (level >> b) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - bit)))
        lo0, hi0 = zeros[lo], zeros[hi]
        one = ((limit >> b) & 1) == 1
        found += np.where(one, hi0 - lo0, 0)
        lo = np.where(one, zeros[-1] + lo - lo0, lo0)
        hi = np.where(one, zeros[-1] + hi - hi0, hi0)
        level = np.concatenate((level[bit == 0], level[bit == 1]))
    return found


def _count_blocks(rows: pd.DataFrame, block: np.ndarray) -> pd.DataFrame:
    """For every query, the points of its block with smaller x and smaller y; in blocks of
    kind 0 less all with smaller x."""
    wide_x, wide_y = int(rows["x"].max()) + 2, int(rows["y"].max()) + 2
    x = block * wide_x + rows["x"].to_numpy()
    y = block * wide_y + rows["y"].to_numpy()
    point = rows["is_point"].to_numpy()
    order = np.argsort(x[point], kind="stable")
    at = x[point][order]
    levels = np.unique(y[point])
    values = np.searchsorted(levels, y[point][order])
    limit = np.searchsorted(levels, y[~point])
    # Points of earlier blocks precede in x and are smaller in y: take them off.
    before = np.searchsorted(at, block[~point] * wide_x)
    upto = np.searchsorted(at, x[~point])
    n = count_below(values, upto, limit) - before
    asks = rows[~point]
    n -= np.where(asks["kind"].to_numpy() == 0, upto - before, 0)
    return pd.DataFrame({"grp": asks["grp"], "query": asks["query"], "n": n})


_BLOCK = ["grp", "kind", "cell"]


def _block_numbers(rows: pd.DataFrame) -> np.ndarray:
    keys = rows[_BLOCK]
    return (keys != keys.shift()).any(axis=1).cumsum().to_numpy() - 1


def _count_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts complete blocks as the sorted partition streams through."""
    held: list[pd.DataFrame] = []
    open_key = None
    for pdf in batches:
        block = _block_numbers(pdf)
        key = tuple(pdf[_BLOCK].iloc[-1])
        if block[-1] == 0 and key == open_key:
            held.append(pdf)
            continue
        tail = block == block[-1]
        done = held + ([pdf[~tail]] if block[-1] else [])
        if done:
            rows = pd.concat(done, ignore_index=True)
            yield _count_blocks(rows, _block_numbers(rows))
        held, open_key = [pdf[tail]], key
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield _count_blocks(rows, np.zeros(len(rows), np.int64))


def distinct_between(points: DataFrame, queries: DataFrame,
                     slice_positions: int = POSITIONS_PER_SLICE) -> DataFrame:
    """``points(grp, pos, prev)`` and ``queries(grp, query, p, j)`` ->
    ``(grp, query, distance)``: distinct keys strictly between p and j.

    ``pos`` runs 1..n inside ``grp``, ``prev`` is 0 for a first access (which may be left
    out), ``query`` is any long that is unique inside ``grp``.
    """
    def cell(c):
        return F.floor((F.col(c) - 1) / F.lit(slice_positions)).cast("long")

    pts = points.where("prev > 0").select("grp", "pos", "prev", cell("pos").alias("pos_slice"),
                        cell("prev").alias("prev_slice"))
    ask = queries.select("grp", "query", F.col("j").alias("pos"), F.col("p").alias("prev"),
                         cell("j").alias("pos_slice"), cell("p").alias("prev_slice"))

    def block(df, kind, cell_, x, y, query, is_point):
        return df.select("grp", F.lit(kind).alias("kind"), F.col(cell_).alias("cell"),
                         F.col(x).alias("x"), F.col(y).alias("y"),
                         query.cast("long").alias("query"), F.lit(is_point).alias("is_point"))

    # A key that comes back within the slice of its previous access has nothing to
    # count across slices; streams of a single slice skip that part altogether.
    far = ask.where("pos_slice > prev_slice")
    asked = far.select("grp", "prev_slice").distinct()
    crossed = pts.join(asked, ["grp", "prev_slice"], "left_semi")
    none, name = F.lit(0), F.col("query")
    blocks = (block(pts, 0, "pos_slice", "pos", "prev", none, True)
              .unionByName(block(ask, 0, "pos_slice", "pos", "prev", name, False))
              .unionByName(block(crossed, 1, "prev_slice", "prev", "pos_slice", none, True))
              .unionByName(block(far, 1, "prev_slice", "prev", "pos_slice", name, False)))
    counted = fold_sorted(blocks, ["grp", "kind", "cell"], [], _count_sorted,
                          f"grp {dict(points.dtypes)['grp']}, query long, n long")

    # Grid: points per (row slice a, prev slice b), summed over a' < a and b' < b. A strip of
    # nothing below all others gives every row slice up to the last one asked for its sums.
    cells = pts.groupBy("grp", "pos_slice", "prev_slice").agg(F.count(F.lit(1)).alias("c"))
    last = ask.groupBy("grp").agg(F.max("pos_slice").alias("last"))
    zero, below = F.lit(0).cast("long"), F.lit(-1).cast("long")
    cells = cells.join(last, "grp").where("pos_slice <= last").unionByName(last.select(
        "grp", zero.alias("pos_slice"), below.alias("prev_slice"), zero.alias("c"), "last"))
    by_strip = Window.partitionBy("grp", "prev_slice").orderBy("pos_slice")
    strips = (cells
              .withColumn("upto", F.lead("pos_slice").over(by_strip) - 1)
              .withColumn("c", F.sum("c").over(by_strip))
              .withColumn("a", F.explode(F.sequence(F.col("pos_slice"),
                                                    F.coalesce("upto", "last")))))
    before_b = (Window.partitionBy("grp", "a").orderBy("prev_slice")
                .rowsBetween(Window.unboundedPreceding, 0))
    # Cumulative over all strips up to b, read for row slices before a + 1.
    grid = strips.select("grp", (F.col("a") + 1).alias("pos_slice"),
                         (F.col("prev_slice") + 1).alias("b"),
                         F.sum("c").over(before_b).alias("whole"))
    until = Window.partitionBy("grp", "pos_slice").orderBy("b")
    grid = grid.withColumns({"b_next": F.lead("b").over(until),
                             "all": F.max("whole").over(Window.partitionBy("grp", "pos_slice"))})
    grid = grid.withColumn("prev_slice", F.explode(F.sequence(
        F.col("b"), F.greatest(F.col("b"), F.coalesce(F.col("b_next") - 1, F.col("pos_slice"))))))
    grid = grid.select("grp", "pos_slice", "prev_slice", (F.col("whole") - F.col("all")).alias("whole"))

    parts = counted.groupBy("grp", "query").agg(F.sum("n").alias("own"))
    return (ask.join(grid, ["grp", "pos_slice", "prev_slice"], "left")
            .join(parts, ["grp", "query"])
            .select("grp", "query",
                    (F.col("pos") - 1 - F.col("prev") + F.col("own") + F.coalesce("whole", F.lit(0)))
                    .alias("distance")))
