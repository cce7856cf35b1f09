"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

Every pair of adjacent words votes on each bit of the fingerprint with the sign of
that bit in its hash and the bytes of the pair as weight, so pairs of short, frequent
words say little. Texts are split in Spark partitions; a vote is a matrix product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelog.llm.wordhash import blocks, hashed_words, mix
from servelog.session import cut

BITS = 128
RADIUS = 3
_LANES = BITS // 64
_SALT = np.uint64(0xD1B54A32D192ED03)
_ROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("__part", pa.int32()), ("__first", pa.string()), ("__last", pa.string())]
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double, "
           "__part int, __first string, __last string")


def fingerprints(bodies: list[bytes]) -> np.ndarray:
    """One row of ``BITS`` booleans per text. A text of one word votes with that word;
    without words all bits are 0."""
    out = np.zeros((len(bodies), BITS), bool)
    for part in blocks([len(b) for b in bodies]):
        words, sizes, counts = hashed_words(bodies[part])
        pair = np.concatenate([mix(words[:-1] * np.uint64(3) + words[1:]), words[-1:]])
        weight = np.concatenate([sizes[:-1] + sizes[1:], sizes[-1:]]).astype("float32")
        lanes = np.stack([pair] + [mix(pair + _SALT * np.uint64(k)) for k in range(1, _LANES)], 1)
        at = 0
        for row, n in zip(range(part.start, part.stop), counts.tolist()):
            if n == 1:
                one = words[at:at + 1]
                bits = np.stack([one] + [mix(one + _SALT * np.uint64(k)) for k in range(1, _LANES)], 1)
                out[row] = np.unpackbits(bits.view("uint8"), axis=1)[0]
            elif n:
                votes = np.zeros(BITS)
                for first in range(at, at + n - 1, 65_536):  # bounded memory for very long texts
                    last = min(first + 65_536, at + n - 1)
                    bits = np.unpackbits(lanes[first:last].view("uint8"), axis=1)
                    votes += weight[first:last] @ bits.astype("float32")
                out[row] = 2 * votes > float(weight[at:at + n - 1].sum(dtype="float64"))
            at += n
    return out


def _hex(bits: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.packbits(bits, axis=1)] if len(bits) else []


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(ids, texts: list[str], marks: np.ndarray, nexts: list[str], next_marks: np.ndarray):
    changed = [edited(t, n).encode() for t, n in zip(texts, nexts)]
    changed_marks = fingerprints(changed)
    same = lambda a, b: (a == b).mean(axis=1) if len(a) else np.zeros(0)
    return [ids, [len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed],
            _hex(marks), _hex(changed_marks), same(marks, changed_marks), same(marks, next_marks)]


def _batch(columns, part=None, first=None, last=None) -> pa.RecordBatch:
    n = len(columns[0])
    columns = [*columns, [part] * n, [first] * n, [last] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _ROW)],
                                      names=[name for name, _ in _ROW])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition; its first and last text leave in one border row, for
    the last document's next one is in another partition."""
    part, first, held = TaskContext.get().partitionId(), None, None
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        if not ids:
            continue
        marks = fingerprints([t.encode() for t in texts])
        if held is None:
            first = texts[0]
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
            marks = np.concatenate([held[2], marks])
        held = (ids[-1], texts[-1], marks[-1:])
        yield _batch(_rows(ids[:-1], texts[:-1], marks[:-1], texts[1:], marks[1:]))
    if held is not None:
        yield _batch([[held[0]], [None], [None], [None], [None], [None], [None]], part, first, held[1])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lasts, nexts = (batch.column(k).to_pylist() for k in range(3))
        yield _batch(_rows(ids, lasts, fingerprints([t.encode() for t in lasts]),
                           nexts, fingerprints([t.encode() for t in nexts])))


def fingerprint_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, fingerprint (hex), and the same of the edited text, whose last half is
    taken from the next document by descending doc_id (after the last: the first).

    Null texts are empty. A null doc_id comes after all others; rows with one doc_id are
    ordered by a hash of their text. A single document is its own next one. The texts
    are moved once, into ranges of doc_id; two of each range meet its neighbours.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Sorted by (id, tie) in ranges of both, so a repeated doc_id is no hot range.
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                        F.xxhash64(text).alias("__tie"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("__tie")]
    sorted_ = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = cut(sorted_.select("doc_id", "text").mapInArrow(_along, _SCHEMA))
    borders = rows.where(F.col("__part").isNotNull())
    around = Window.orderBy("__part")  # a row per partition
    meet = (borders.withColumn("__next", F.lead("__first").over(around))
            .withColumn("__head", F.first("__first").over(
                around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .select("doc_id", "__last", F.coalesce("__next", "__head")))
    return (rows.where(F.col("__part").isNull()).union(meet.mapInArrow(_across, _SCHEMA))
            .drop("__part", "__first", "__last"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hex fingerprints differ."""
    def lane(k: int) -> Column:
        x, y = (F.conv(F.substring(c, 16 * k + 1, 16), 16, -10).cast("long") for c in (a, b))
        return F.bit_count(x.bitwiseXOR(y))
    return sum((lane(k) for k in range(1, _LANES)), lane(0))


def near_fingerprints(marks: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = 4,
                      keep: int = 1) -> DataFrame:
    """(query, found, distance) for all fingerprints within ``radius`` of a query fingerprint.

    Fingerprints are cut into ``blocks``; within ``blocks - keep`` differing bits some
    ``keep`` blocks agree, so a table keyed by each choice of them finds every pair. Both
    inputs have a column ``fingerprint``; equal ones count once. A pair found by several
    tables is kept by the first, so nothing has to be made distinct.
    """
    if radius > blocks - keep:
        raise ValueError("blocks - keep must be at least the radius")
    digits = BITS // 4
    bounds = [digits * b // blocks for b in range(blocks + 1)]
    choices = list(combinations(range(blocks), keep))

    def block(column: str, b: int) -> Column:
        return F.substring(column, bounds[b] + 1, bounds[b + 1] - bounds[b])

    def keyed(frame: DataFrame, name: str) -> DataFrame:
        rows = frame.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        keys = F.array(*[F.concat_ws("|", F.lit(str(t)), *[block(name, b) for b in choice])
                         for t, choice in enumerate(choices)])
        return rows.select(name, F.posexplode(keys).alias("__table", "__key"))

    left, right = keyed(queries, "query"), keyed(marks, "found").drop("__table")
    pairs = left.join(right, "__key").withColumn("distance", hamming(F.col("query"), F.col("found")))
    agree = [F.lit(True) for _ in choices]
    for t, choice in enumerate(choices):
        for b in choice:
            agree[t] = agree[t] & (block("query", b) == block("found", b))
    first = F.coalesce(*[F.when(a, F.lit(t)) for t, a in enumerate(agree)])
    return (pairs.where((F.col("distance") <= radius) & (first == F.col("__table")))
            .select("query", "found", "distance"))
