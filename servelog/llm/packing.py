"""Best-fit decreasing packing of token sequences into windows.

Overlong documents are cut into full windows first; what is left of each is one
piece. Best fit needs lengths only, and pieces of one length are interchangeable, so
the plan is made from the histogram of lengths: at most ``window`` rows reach the
driver, whatever the corpus holds. A segment tree indexed by remaining capacity finds
the tightest open windows, in whole groups. Pieces learn their place from their rank
within their length, by hash buckets of bounded size with offsets, so no length is ever
gathered in one task. The rank follows from the pieces alone: the same documents in other
files or partitions are packed alike.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servelog.llm.tokens import encoder
from servelog.session import cut

WINDOW = 2048
END_ID = 1
BUCKET_PIECES = 200_000  # equally long pieces ranked in one task
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Segment tree over remaining capacities; finds the least open one at or above a need."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, groups: int) -> None:
        node = self.size + capacity
        while node:
            self.open[node] += groups
            node >>= 1

    def tightest(self, need: int) -> int | None:
        node = self.size + need
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Runs (length, first_rank, last_rank + 1, first_window, per_window, offset).

    The ``k``-th piece of a length lies in window ``first_window + (k - first_rank) //
    per_window``. Equals best-fit decreasing piece by piece: after a piece goes into the
    tightest window, that window stays the tightest for the next of equal length until
    it is too full. Open groups are split at most twice per length, so their number
    is bounded by the window, not by the corpus.
    """
    tree, groups = CapacityTree(window), defaultdict(list)
    runs, windows = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # new windows for all that are left
                per = window // length
                first, n, room = windows, -(-left // per), window
                windows += n
            else:
                first, n = groups[room].pop()
                tree.add(room, -1)
                per = room // length
            used = min(n, -(-left // per))
            placed = min(left, used * per)
            runs.append((length, rank, rank + placed, first, per, window - room))
            last = placed - (used - 1) * per  # pieces in the last window used
            full = used if last == per else used - 1
            for start, many, after in ((first, full, room - per * length),
                                       (first + full, used - full, room - last * length),
                                       (first + used, n - used, room)):
                if many and after:
                    groups[after].append((start, many))
                    tree.add(after, 1)
            rank, left = rank + placed, left - placed
    return runs


def cut_pieces(docs: DataFrame, text: str = "text", window: int = WINDOW, end_id: int = END_ID,
               tokenizer: str = "byte_bpe_50k.json",
               ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Pieces of at most ``window`` ids per document, closed by ``end_id``; a null text is
    empty and still has the closing id."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = encoder(tokenizer, ranks).ids, np.array([end_id], "<u4").tobytes()
        step, crc32 = 4 * window, zlib.crc32
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buffer = ids(body) + end
                total = len(buffer) // 4
                for at in range(0, len(buffer), step):
                    piece = buffer[at:at + step]
                    rows.append((doc_id, at // 4, len(piece) // 4, crc32(piece), total))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", text).mapInArrow(pieces, _PIECES)


def pack(docs: DataFrame, text: str = "text", window: int = WINDOW, **tokens) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Rows with equal doc_id are packed as documents of their own; other columns are
    not looked at. An empty table gives no rows.
    """
    pieces = cut(cut_pieces(docs, text, window, **tokens))
    counts = {r["length"]: r["n"] for r in  # one row per length, at most ``window``
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(best_fit_decreasing(counts, window) or np.zeros((0, 6)), "int64")
    what = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    buckets = -(-max(counts.values(), default=1) // BUCKET_PIECES)
    pieces = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*what), F.lit(buckets)))
    before = (pieces.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("__n"))
        .drop("__n"))
    nth = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*what)) - 1
    ranked = (pieces.withColumn("__nth", nth).join(before, ["length", "__bucket"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("__nth") + F.col("__before")).alias("__rank")))
    reach = int(max(counts.values(), default=0)) + 1
    key = runs[:, 0] * reach + runs[:, 1]
    order = np.argsort(key)
    key, runs = key[order], runs[order]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank, length = frame.pop("__rank").to_numpy(), frame["length"].to_numpy()
            run = runs[np.searchsorted(key, length * reach + rank, "right") - 1]
            nth = rank - run[:, 1]
            frame["sequence_id"] = run[:, 3] + nth // np.maximum(run[:, 4], 1)
            frame["offset"] = run[:, 5] + nth % np.maximum(run[:, 4], 1) * length
            yield frame

    return ranked.mapInPandas(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
               "sequence_id long, offset long")
