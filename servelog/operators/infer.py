"""Run a pluggable model over batches of rows, inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelog.plans.sliced import SLICE_ROWS, even_slice, sliced_row_number

MAX_BATCH = 16
SLICE_BYTES = 32_000_000
CHUNK = 64  # batches that stay together when they are dealt to tasks

Predict = Callable[[Sequence[str]], tuple[list[str], float]]


def batch_infer(df: DataFrame, text: str, make_predict: Callable[[], Predict],
                batch_size: int = MAX_BATCH, order: str | None = None) -> DataFrame:
    """Add ``output``, ``batch_size`` and ``inference_ms``.

    ``make_predict`` runs once per task, so a model loads once per task; the function
    it returns gets whole texts (null: empty) and gives an answer per text and the time
    taken. A partition's rows are cut into batches of ``batch_size``, the last may be
    smaller; the size of the chunks they arrive in does not matter. With ``order``, a distinct
    integer column, the table's rows by that order are the batches, however they are
    partitioned: only the last batch of all is smaller.
    """
    if order is not None:
        return _ordered(df, text, make_predict, batch_size, order)
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict, held = make_predict(), None
        for chunk in chunks:
            held = chunk if held is None or held.empty else pd.concat([held, chunk], ignore_index=True)
            full = len(held) // batch_size * batch_size
            for at in range(0, full, batch_size):
                yield answered(predict, held.iloc[at:at + batch_size])
            held = held.iloc[full:]
        if held is not None and not held.empty:
            yield answered(predict, held)

    def answered(predict: Predict, part: pd.DataFrame) -> pd.DataFrame:
        answers, ms = predict(part[text].fillna("").tolist())
        return part.assign(output=answers, batch_size=len(part), inference_ms=float(ms))

    return df.mapInPandas(run, f"{fields}, output string, batch_size int, inference_ms double")


def _ordered(df: DataFrame, text: str, make_predict: Callable[[], Predict], batch_size: int,
             order: str) -> DataFrame:
    """Rows are numbered by slices of ``order`` and whole batches dealt to tasks. A task may hold
    several runs of batches; each is a multiple of the batch size, but for the last of all,
    which has the highest numbers and so ends its task."""
    # A slice's rows meet in one task with their texts, so it is bounded by bytes.
    size = df.agg(F.avg(F.octet_length(F.col(text)))).first()[0] or 1
    slice_rows = max(batch_size * CHUNK, int(SLICE_BYTES / max(size, 1)))
    slice_ = even_slice(df.where(F.col(order).isNotNull()), order, min(SLICE_ROWS, slice_rows))
    rows = sliced_row_number(df, [], [order], slice_, "__n").withColumn(
        "__n", F.col("__n") - 1)
    per_task = batch_size * CHUNK
    dealt = rows.repartition(F.floor(F.col("__n") / per_task)).sortWithinPartitions("__n")
    return batch_infer(dealt, text, make_predict, batch_size).drop("__n")
