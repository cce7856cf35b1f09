"""Equi-joins in which NULL keys meet, as they do in GROUP BY and PARTITION BY."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """``left`` and the other columns of ``right`` where all ``keys`` are equal or both NULL."""
    names = {k: f"__right_{k}" for k in keys}
    on = None
    for key, name in names.items():
        same = F.col(key).eqNullSafe(F.col(name))
        on = same if on is None else on & same
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def solid(col: str | Column) -> Column:
    """A string for any value that tells NULL from all others: a key for inner joins."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("-"))
