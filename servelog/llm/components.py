"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelog.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v")).distinct())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge that is not its component's least node, which
    is ``root``. Nodes of any ordered type without nulls; loops and repeated edges are
    ignored. Each round is written, so a lost executor costs a re-read; rounds grow
    with the logarithm of the longest path.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .where(F.col("u") != F.col("v")).distinct())
    while not _settled(now):
        now = cut(_small_star(cut(_large_star(now))))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Every node points to one lesser node at most, and none that is pointed to points on."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where(
        (F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))
    return odd.isEmpty()
