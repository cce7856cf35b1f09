"""Spelling variants: words one letter apart, found in sorted permuterm rotations.

A word with an end mark has as many rotations as characters. Rotated so that an edited
character stands last, two words that differ in it alone begin alike, so a lookup with an
unknown character is a prefix. Each word gives, for every letter, the rotation without that
letter ("open" entries), and all rotations of the whole word ("closed" ones):

* equal open entries of different words: one letter replaced by another,
* an open entry equal to a closed one: a letter deleted, or inserted the other way.

A key holds one closed entry at most and an open one per letter of the alphabet, so groups
are bounded by its size and no group of variants is ever compared whole. Of a run of
equal letters only the first may go missing, so every pair meets under one key.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelog.session import cut

LEAST_LETTERS = 5
LEAST_TIMES = 3
RATIO = 2  # a form is this many times as frequent
#: One in so many words of a document loses a letter (a planted error, by checksum); 0: none.
DAMAGE = 97
HELD_WORDS = 200_000
END = "$"  # sorts before all letters
_RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def damaged(word: str, doc_id, every: int = DAMAGE) -> str:
    """``word`` without one letter if ``every`` divides the checksum of the two."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if every and h % every == 0:
        at = h % len(word)
        return word[:at] + word[at + 1:]
    return word


def _words(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            out = [(w, n) for w, n in held.items() if len(w) >= LEAST_LETTERS]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()),
                                               pa.array([n for _, n in out], pa.int64())], schema=_COUNTED)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(_RUN.findall((text or "").translate(_LOWER))).items():
                    held[damaged(word, doc_id, every)] += n
                if len(held) > HELD_WORDS:
                    yield rows()
        if held:
            yield rows()
    return run


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = DAMAGE) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences in whole texts. Runs of letters,
    A-Z in lower case. Null texts have none; a null doc_id reads as ''; repeated rows count again."""
    return (docs.select(F.col(doc_id), F.col(text)).mapInArrow(_words(every), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES))


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, closed, first): open and closed entries of every word; ``first`` tells that
    the left-out letter begins a run of equal ones."""
    word, size = F.col("word"), F.length("word")
    letter = lambda i: F.substring(word, i, F.lit(1))
    around = lambda left, i: F.concat(F.substring(word, left, size), F.lit(END), F.substring(word, F.lit(1), i - 1))
    opened = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
        around(i + 1, i).alias("key"), F.lit(False).alias("closed"),
        ((i == 1) | (letter(i) != letter(i - 1))).alias("first")))
    closed = F.transform(F.sequence(F.lit(1), size + 1), lambda i: F.struct(
        around(i, i).alias("key"), F.lit(True).alias("closed"), F.lit(True).alias("first")))
    return words.select("word", "n", F.inline(F.concat(opened, closed)))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words one letter apart, once each."""
    groups = (rotations(words).groupBy("key")
              .agg(F.collect_list(F.struct("word", "n", "closed", "first")).alias("all"))
              .where(F.size("all") > 1))
    meets = lambda a, b: (a["word"] != b["word"]) & F.when(a["closed"], b["first"]).when(
        b["closed"], a["first"]).otherwise(True)
    pairs = groups.select(F.inline(F.flatten(F.transform("all", lambda a: F.transform(
        F.filter("all", lambda b: meets(a, b)), lambda b: F.struct(
            a["word"].alias("word"), a["n"].alias("n"), b["word"].alias("near"), b["n"].alias("near_n")))))))
    return pairs


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n).

    A word's form is the most frequent of the words one letter apart (of equal ones the least)
    if it is at least ``RATIO`` times as frequent, else null; its root is the end of the chain
    of forms. Counts grow along a chain, so it has as many steps as doublings of
    the largest count, and halving chains takes the logarithm of that in rounds.
    """
    none = words.select("word", "n", F.lit(0).alias("near"), F.lit(None).cast("struct<m:bigint,w:string>").alias("best"))
    found = neighbours(words).select("word", "n", F.lit(1).alias("near"),
                                     F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")).alias("best"))
    table = (none.union(found).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
        .withColumn("ok", -F.col("best.m") >= RATIO * F.col("n"))
        .select("word", "n", "n_near", F.when(F.col("ok"), F.col("best.w")).alias("form"),
                F.when(F.col("ok"), -F.col("best.m")).alias("form_n")))
    table = cut(table)
    up = table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        onward = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(up.join(onward, "root", "left").select("word", "root", "next"))
        up = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where(F.col("next").isNotNull()).isEmpty():
            break
    return table.join(up, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
