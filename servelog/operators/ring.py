"""Consistent-hash ring as a table.

A ring is a list of arcs ``[lo, hi)``; the worker at ``hi`` owns the keys in it
(first position strictly after the key, wrapping to the smallest). Ring tables
grow with the fleet (vnodes x workers), never with the log. Keys find their arc
by an equi-join on the leading hex digits of the position; inside a bucket the arcs
do not overlap, so each key matches exactly one and needs no aggregation. Rings
beyond ``_BROADCAST_ROWS`` arcs are numbered slice by slice, have more buckets, so
that one holds few arcs however large the fleet, and are shuffled, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelog.functions.keys import BUCKET_DIGITS, ring_bucket, ring_position
from servelog.plans.sliced import sliced_lag, sliced_row_number
from servelog.session import cut

VNODES = 160  # Fixed value: virtual nodes per worker.
_BROADCAST_ROWS = 200_000
_LOW, _HIGH = "", "g"  # below and above every hex position


def ring_table(workers: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(pos, worker_id) with ``vnodes`` rows per worker."""
    v = workers.select("worker_id", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
    return v.select(ring_position(F.concat_ws("#", "worker_id", "v")).alias("pos"), "worker_id")


def _digits(n_arcs: int) -> int:
    """Hex digits of a bucket: 16 arcs or fewer in one on average, once arcs are not broadcast."""
    digits = BUCKET_DIGITS
    while n_arcs > _BROADCAST_ROWS and 16 ** (digits + 1) < n_arcs:
        digits += 1
    return digits


def _number(position: str, digits: int) -> Column:
    return F.conv(ring_bucket(position, digits), 16, 10).cast("long")


def ring_arcs(ring: DataFrame, n_arcs: int = 0) -> DataFrame:
    """(arc, lo, hi, worker_id); the wrapping arc appears as two pieces. ``n_arcs`` is the size
    of the ring where it may be large."""
    nodes = ring.groupBy("pos").agg(F.min("worker_id").alias("worker_id"))
    if n_arcs > _BROADCAST_ROWS:
        slice_ = _number("pos", BUCKET_DIGITS)
        nodes = cut(sliced_row_number(cut(nodes), [], ["pos"], slice_, "arc"))
        numbered = (sliced_lag(nodes, [], ["pos"], slice_, ["pos"], "before")
                    .select("arc", F.coalesce("before.pos", F.lit(_LOW)).alias("lo"),
                            F.col("pos").alias("hi"), "worker_id"))
        tail = numbered.where("arc = 1").crossJoin(F.broadcast(ring.agg(F.max("pos").alias("last"))))
    else:
        order = Window.partitionBy(F.lit(0)).orderBy("pos")
        numbered = nodes.select(
            F.row_number().over(order).alias("arc"),
            F.coalesce(F.lag("pos").over(order), F.lit(_LOW)).alias("lo"),
            F.col("pos").alias("hi"), "worker_id",
            F.max("pos").over(Window.partitionBy(F.lit(0))).alias("last"))
        tail = numbered.where("arc = 1")
        numbered = numbered.drop("last")
    return numbered.unionByName(tail.select("arc", F.col("last").alias("lo"),
                                            F.lit(_HIGH).alias("hi"), "worker_id"))


def arc_preferences(ring: DataFrame) -> DataFrame:
    """(arc, rank, worker_id): distinct workers clockwise from each arc."""
    order = Window.partitionBy(F.lit(0)).orderBy("pos")
    nodes = (ring.groupBy("pos").agg(F.min("worker_id").alias("worker_id"))
             .select(F.row_number().over(order).alias("arc"), "worker_id",
                     F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("m")))
    twice = nodes.select("arc", F.explode(F.array(F.col("arc"), F.col("arc") + F.col("m")))
                         .alias("i"), "worker_id", "m")
    # Next vnode of every worker at or after position i.
    own = twice.groupBy("worker_id", "m").agg(F.sort_array(F.collect_list("i")).alias("at"))
    gaps = (own.select("worker_id", "m", F.posexplode("at").alias("n", "i"), "at")
            .withColumn("since", F.when(F.col("n") == 0, F.lit(1))
                        .otherwise(F.element_at("at", F.greatest(F.col("n"), F.lit(1))) + 1)))
    reach = (gaps.select("worker_id", "m", "i", F.explode(F.sequence("since", "i")).alias("arc"))
             .where("arc <= m"))
    rank = Window.partitionBy("arc").orderBy("i")
    return reach.select("arc", F.row_number().over(rank).alias("rank"), "worker_id")


def _pieces(arcs: DataFrame, digits: int) -> DataFrame:
    first = F.when(F.col("lo") == _LOW, F.lit(0)).otherwise(_number("lo", digits))
    last = F.when(F.col("hi") == _HIGH, F.lit(16 ** digits - 1)).otherwise(_number("hi", digits))
    numbered = arcs.withColumn("n", F.explode(F.sequence(first, last)))
    return numbered.withColumn("bucket", F.format_string(f"%0{digits}x", "n")).drop("n")


def arc_table(ring: DataFrame, n_arcs: int = 0) -> DataFrame:
    """Arcs by bucket: (bucket, lo, hi, arc, worker_id). ``n_arcs`` is the size of the ring where
    it may be large; ``locate`` takes the same."""
    return _pieces(ring_arcs(ring, n_arcs), _digits(n_arcs))


def locate(keys: DataFrame, arcs: DataFrame, key: str | Column = "key", n_arcs: int = 0) -> DataFrame:
    """Add ``arc`` and the owner's ``worker_id`` to rows; no shuffle of ``keys``
    while the arc table is small enough to broadcast."""
    # The optimizer takes a ring for as large as its fleet: it must not choose by that.
    arcs = arcs.hint("merge") if n_arcs > _BROADCAST_ROWS else F.broadcast(arcs)
    rows = (keys.withColumn("__pos", ring_position(key))
            .withColumn("bucket", ring_bucket("__pos", _digits(n_arcs))))
    inside = ((rows["bucket"] == arcs["bucket"]) & (rows["__pos"] >= arcs["lo"])
              & (rows["__pos"] < arcs["hi"]))
    return rows.join(arcs, inside).drop("bucket", "__pos", "lo", "hi")


def _located(keys: DataFrame, ring: DataFrame, key: str | Column) -> DataFrame:
    n_arcs = ring.count()
    return locate(keys, arc_table(ring, n_arcs), key, n_arcs)


def ring_owner(keys: DataFrame, ring: DataFrame, key: str | Column = "key") -> DataFrame:
    """Rows plus the worker owning their key."""
    return _located(keys, ring, key).drop("arc")


def ring_preference(keys: DataFrame, ring: DataFrame, key: str | Column = "key") -> DataFrame:
    """Rows x workers in clockwise order: rank 1 owns, rank 2 takes the spill."""
    return _located(keys, ring, key).drop("worker_id").join(arc_preferences(ring), "arc").drop("arc")


def rebalance_report(keys: DataFrame, before: DataFrame, after: DataFrame,
                     key: str = "key") -> DataFrame:
    """One row: keys, moved keys, fraction, and moves that break the invariant
    (onto a worker that existed before, off a worker that still exists)."""
    old, new = F.col("owner_before"), F.col("owner_after")
    both = (ring_owner(keys.select(key), before, key)
            .withColumnRenamed("worker_id", "owner_before"))
    both = ring_owner(both, after, key).withColumnRenamed("worker_id", "owner_after")
    was = before.select(F.col("worker_id").alias("owner_after")).distinct().withColumn(
        "target_existed", F.lit(True))
    still = after.select(F.col("worker_id").alias("owner_before")).distinct().withColumn(
        "source_exists", F.lit(True))
    if max(before.count(), after.count()) > _BROADCAST_ROWS:
        was, still = was.hint("merge"), still.hint("merge")
    marked = both.join(was, "owner_after", "left").join(still, "owner_before", "left")
    moved = old != new
    return marked.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(moved).alias("n_moved"),
        F.avg(moved.cast("double")).alias("fraction_moved"),
        F.count_if(moved & F.col("target_existed").isNotNull()
                   & F.col("source_exists").isNotNull()).alias("n_unneeded"))
