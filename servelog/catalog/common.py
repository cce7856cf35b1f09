"""Small helpers of the query catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(expr: str | Column, name: str | None = None) -> Column:
    """Doubles depend on summation order in their last bits: compare 6 digits."""
    col = F.col(expr) if isinstance(expr, str) else expr
    return F.round(col, 6).alias(name or expr)
