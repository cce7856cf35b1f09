"""Exact length histogram: totals, quantiles and truncated totals for every context limit.

Documents are counted by encoded length map-side, so one row per distinct length is
shuffled. Suffix sums over that histogram answer any question about a limit ``c``:
``sum(min(length, c)) = tokens below c + c * documents of c or more``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelog.llm.tokens import encoder
from servelog.plans.sliced import sliced_running_sum

_SLICE = 1024


def encoded_lengths(docs: DataFrame, text: str = "text", keep: Sequence[str] = (),
                    tokenizer: str = "byte_bpe_50k.json",
                    ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``length`` (tokens of the whole text; null and empty: 0) beside the ``keep`` columns."""
    cols = docs.select(*keep, F.col(text).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer, ranks).ids
        for batch in batches:
            lengths = [len(ids(t)) // 4 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(lengths, pa.int64())],
                names=[*keep, "length"])

    schema = ", ".join([*(f"`{c}` {cols.schema[c].dataType.simpleString()}" for c in keep),
                        "length long"])
    return cols.mapInArrow(count, schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs), one row per distinct length."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_table(histogram: DataFrame) -> DataFrame:
    """One row per distinct length, taken as a context limit:

    ``docs_ge``, ``tokens_ge`` count the documents that reach it, ``docs_le``,
    ``tokens_le`` those that fit, ``truncated_total`` the tokens left when every
    document is cut there, ``share_le`` the part of documents that fit (the quantile
    of this length). An empty table gives no rows.
    """
    rows = histogram.select("length", "n_docs",
                            (F.col("length") * F.col("n_docs")).alias("__tokens"))
    down = [F.col("length").desc()]
    part = F.floor(-F.col("length") / _SLICE).cast("long")
    rows = sliced_running_sum(rows, [], down, part, "n_docs", "docs_ge")
    rows = sliced_running_sum(rows, [], down, part, "__tokens", "tokens_ge")
    whole = rows.agg(F.sum("n_docs").alias("__docs"), F.sum("__tokens").alias("__all"))
    return rows.join(F.broadcast(whole), F.lit(True)).select(
        "length", "n_docs", "docs_ge", "tokens_ge",
        (F.col("__docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        (F.col("__all") - F.col("tokens_ge") + F.col("__tokens")).alias("tokens_le"),
        (F.col("__all") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge"))
        .alias("truncated_total"),
        ((F.col("__docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("__docs"))
        .alias("share_le"))


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, n_docs, total_tokens, docs_over, truncated_total) for given limits; the
    histogram is scanned once whatever their number, a row per limit comes back."""
    spread = histogram.withColumn("limit", F.explode(F.array(*[F.lit(int(c)) for c in limits])))
    length, n = F.col("length"), F.col("n_docs")
    return spread.groupBy("limit").agg(
        F.sum("n_docs").alias("n_docs"), F.sum(length * n).alias("total_tokens"),
        F.sum(F.when(length > F.col("limit"), n).otherwise(0)).alias("docs_over"),
        F.sum(F.least(length, F.col("limit")) * n).alias("truncated_total"))


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the least length that at least this share of documents does not
    exceed."""
    table = suffix_table(histogram)
    spread = table.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return (spread.where(F.col("share_le") >= F.col("share"))
            .groupBy("share").agg(F.min("length").alias("length")))
