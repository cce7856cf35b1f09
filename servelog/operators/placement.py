"""Assigning every row of a log to a worker.

Load is the number of rows a worker takes inside a window. Bounded load walks a
row's ring preferences and takes the first worker whose load is still below
``cap_factor * max(mean load, 1)``; round r offers the rows left over from
earlier rounds to their r-th preference, oldest first.

A round is decided by one number per (window, worker): the ``seq`` of the last
row that still fits. All rows of a ring arc ask the same worker in a round, so what
is left of an arc is always its rows after some ``seq``, and a histogram of the log
by (window, arc, slice) carries every round of every cap. The log is read once, to
write its narrow form (window, arc, slice, seq); a round reads of that form only the
slices in which a worker fills up, and one join at the end gives the rows their
workers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelog.operators.ring import arc_preferences, arc_table, locate, ring_table
from servelog.plans.joins import solid
from servelog.plans.sliced import dense_slice, sliced_row_number
from servelog.session import cut

UNBOUNDED = float("inf")
# The sweep of cap factors, from flat load to pure affinity.
CAP_SWEEP = (1.05, 1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, UNBOUNDED)

# Joins go by ``__win``, in which a NULL window is a window of its own.
# ``__class`` tells rows apart that different workers can serve.
_GROUP = ["cap_factor", "__win", "__class"]


def fleet(workers: DataFrame, load: Column | None = None) -> list[tuple[str, float]]:
    """Sorted (worker_id, load) of the registry: configuration, not log data."""
    load = F.lit(0.0) if load is None else load
    rows = workers.select("worker_id", load.cast("double").alias("load")).collect()
    return sorted((r["worker_id"], r["load"]) for r in rows)


_WHO = [*_GROUP, "worker_id"]
_ARC = ["__win", "__class", "arc"]


def _room(counts: DataFrame, base: DataFrame) -> DataFrame:
    """(cap_factor, __win, __class, worker_id, room): rows each worker may take, from the
    first round's counts, in which every row of the log asks once."""
    cap = F.col("cap_factor") * F.greatest((F.col("n_rows") + F.col("total")) / F.col("n"), F.lit(1.0))
    left = F.when(F.col("cap_factor") == UNBOUNDED, F.lit(2 ** 62)).otherwise(
        F.greatest(F.ceil(cap - F.col("base")), F.lit(0)))
    return (counts.groupBy(*_GROUP).agg(F.sum("c").alias("n_rows")).join(base, "__class")
            .select(*_WHO, left.cast("long").alias("room")))


def _standing(counts: DataFrame, room: DataFrame) -> DataFrame:
    """(cap_factor, __win, worker_id, room, total) of every worker of the fleet."""
    totals = counts.groupBy(*_WHO).agg(F.sum("c").alias("total"))
    return (room.join(totals, _WHO, "left")
            .select(*_WHO, "room", F.coalesce("total", F.lit(0)).alias("total")))


def _marks(counts: DataFrame, standing: DataFrame) -> DataFrame:
    """Standing of every worker with ``whole``, the end of the last slice it takes whole, and
    the slice in which it fills up, of which it takes the first ``fits`` rows."""
    upto = Window.partitionBy(*_WHO).orderBy("slice")
    ends = counts.withColumn("end", F.sum("c").over(upto)).join(standing, _WHO)
    fills = (F.col("end") - F.col("c") < F.col("room")) & (F.col("end") > F.col("room"))
    found = ends.groupBy(*_WHO).agg(
        F.max(F.when(F.col("end") <= F.col("room"), F.col("slice_end"))).alias("whole"),
        F.max(F.when(fills, F.col("slice"))).alias("slice"),
        F.max(F.when(fills, F.col("room") - F.col("end") + F.col("c"))).alias("fits"))
    return standing.join(found, _WHO, "left")


def _edges(located: DataFrame, asked: DataFrame, marks: DataFrame) -> DataFrame:
    """Of the slices in which workers fill up, per arc: ``partial_end``, the last row taken,
    and ``rest``, the rows left over. Only these slices are ranked row by row."""
    arcs = (asked.join(marks.select(*_WHO, "slice", "fits"), [*_WHO, "slice"])
            .select(*_WHO, "arc", "slice", "floor", "fits"))
    by_seq = Window.partitionBy(*_WHO, "slice").orderBy("seq")
    ranked = (located.select(*_ARC, "slice", "seq").join(arcs, [*_ARC, "slice"])
              .where(F.col("seq") > F.col("floor")).withColumn("rn", F.row_number().over(by_seq)))
    return ranked.groupBy(*_WHO, "arc", "slice").agg(
        F.max(F.when(F.col("rn") <= F.col("fits"), F.col("seq"))).alias("partial_end"),
        F.count_if(F.col("rn") > F.col("fits")).alias("rest"))


def _limits(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """(cap_factor, __win, __class, worker_id, last_seq, room): the last candidate that fits
    and the room left after it."""
    partly = edges.groupBy(*_WHO).agg(F.max("partial_end").alias("partial_end"))
    return marks.join(partly, _WHO, "left").select(
        *_WHO, F.coalesce("partial_end", "whole", F.lit(-1)).alias("last_seq"),
        (F.col("room") - F.least("total", "room")).alias("room"))


def _left_over(asked: DataFrame, limits: DataFrame, edges: DataFrame) -> DataFrame:
    """The histogram of the rows that no worker has taken yet; they follow ``floor``."""
    rest = edges.select(*_GROUP, "arc", "slice", "rest")
    still = F.coalesce("rest", F.when(F.col("slice_end") > F.col("last_seq"), F.col("c")))
    return (asked.join(limits.drop("room"), _WHO).join(rest, [*_GROUP, "arc", "slice"], "left")
            .withColumns({"c": still, "floor": F.greatest("floor", "last_seq")}).where(F.col("c") > 0)
            .select(*_GROUP, "arc", "slice", "c", "slice_end", "floor"))


def _steps(asked: DataFrame, upto: DataFrame | None, rank: int) -> DataFrame:
    """What a round gives to each arc: its rows up to ``upto`` (all, without limits) that no
    earlier round took go to ``worker_id``."""
    arcs = asked.select(*_WHO, "arc").distinct()
    arcs = arcs.withColumn("upto", F.lit(2 ** 63 - 1)) if upto is None else arcs.join(
        upto.select(*_WHO, F.col("last_seq").alias("upto")), _WHO)
    step = F.struct(F.lit(rank).alias("rank"), F.col("upto").cast("long").alias("upto"), "worker_id")
    return arcs.select(*_GROUP, "arc", step.alias("step"))


def place(df: DataFrame, key: str | Column, workers: DataFrame,
          caps: Sequence[float], window: Column, vnodes: int = 160,
          eligible: Column | None = None, load: Column | None = None,
          model: str | Column | None = None, slice_rows: int = 1_000_000) -> DataFrame:
    """(cap_factor, win, seq, worker_id, rank) for every row and cap factor.

    See ``takers``, which gives a row of the log once, with the workers of all caps.
    """
    rows = takers(df, key, workers, caps, window, vnodes, eligible, load, model, slice_rows)
    return rows.select("win", "seq", F.inline("takes")).select("cap_factor", "win", "seq", "worker_id", "rank")


def takers(df: DataFrame, key: str | Column, workers: DataFrame,
           caps: Sequence[float], window: Column, vnodes: int = 160,
           eligible: Column | None = None, load: Column | None = None,
           model: str | Column | None = None, slice_rows: int = 1_000_000) -> DataFrame:
    """(win, seq, takes) with ``takes`` an array of (cap_factor, worker_id, rank), one per cap factor.

    ``worker_id`` is NULL where no worker may take the row. ``eligible`` and
    ``load`` are Columns over ``workers``: who takes part, and the load each
    already carries. With ``model``, a Column over ``df``, a row only goes to workers
    whose ``models`` hold it; the cap is over these and over the rows of that model.
    """
    spark = df.sparkSession
    if eligible is not None:
        workers = workers.where(eligible)
    base = fleet(workers, load)
    holds = {w: {""} for w, _ in base} if model is None else {
        r["worker_id"]: {f"={m}" for m in r["models"] or ()} for r in workers.collect()}
    serving = {c: [(w, b) for w, b in base if c in holds[w]] for c in sorted(set().union(*holds.values()))}
    offers = spark.createDataFrame(
        [(c, w, b, len(ws), sum(b for _, b in ws)) for c, ws in serving.items() for w, b in ws],
        "__class string, worker_id string, base double, n long, total double")
    ids = F.explode(F.array(*[F.lit(w) for w, _ in base])).alias("worker_id")
    ring = ring_table(spark.range(1, numPartitions=1).select(ids), vnodes)
    clockwise = Window.partitionBy("__class", "arc").orderBy("rank")
    prefs = cut(arc_preferences(ring).join(offers.select("__class", "worker_id"), "worker_id")
                .withColumn("rank", F.row_number().over(clockwise)))
    n_arcs = len(base) * vnodes
    arcs = cut(arc_table(ring, n_arcs))
    rows = df.withColumn("win", window).withColumn(
        "__class", F.lit("") if model is None else solid(model))
    spread = F.explode(F.array(*[F.lit(float(c)) for c in caps]))
    located = cut(locate(rows, arcs, key, n_arcs)
                  .select("win", solid("win").alias("__win"), "__class", "seq", "arc",
                          dense_slice("seq", slice_rows).alias("slice")))
    counted = cut(located.groupBy(*_ARC, "slice").agg(F.count(F.lit(1)).alias("c"),
                                                      F.max("seq").alias("slice_end")))
    each_cap = counted.withColumn("cap_factor", spread)
    left, room = each_cap.withColumn("floor", F.lit(-1).cast("long")), None
    steps = []
    for rank in range(1, max(map(len, serving.values()), default=0) + 1):
        choice = prefs.where(F.col("rank") == rank).select("__class", "arc", "worker_id")
        asked = left.join(choice, ["__class", "arc"])
        counts = asked.groupBy(*_WHO, "slice").agg(F.sum("c").alias("c"), F.max("slice_end").alias("slice_end"))
        marks = cut(_marks(counts, _standing(counts, _room(counts, offers) if room is None else room)))
        if marks.where(F.col("total") > F.col("room")).isEmpty():
            steps.append(_steps(asked, None, rank))
            break
        edges = cut(_edges(located, asked, marks))
        limits = _limits(marks, edges)
        steps.append(_steps(asked, limits, rank))
        left = cut(_left_over(asked, limits, edges))
        room = limits.drop("last_seq")
    plan = each_cap.select(*_GROUP, "arc", F.lit(None).cast("struct<rank:int,upto:long,worker_id:string>").alias("step"))
    for part in steps:
        plan = plan.unionByName(part)
    plan = plan.groupBy(*_GROUP, "arc").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    plan = plan.groupBy(*_ARC).agg(F.collect_list(F.struct("cap_factor", "steps")).alias("caps"))

    def take(cap: Column) -> Column:
        step = F.get(F.filter(cap["steps"], lambda s: F.col("seq") <= s["upto"]), F.lit(0))
        return F.struct(cap["cap_factor"].alias("cap_factor"), step["worker_id"].alias("worker_id"),
                        step["rank"].alias("rank"))
    return located.join(plan, _ARC).select("win", "seq", F.transform("caps", take).alias("takes"))


def bounded_load_assign(df: DataFrame, key: str | Column, workers: DataFrame,
                        cap_factor: float, window: Column, **options) -> DataFrame:
    """(win, seq, worker_id, rank): rows some worker took."""
    placed = place(df, key, workers, [cap_factor], window, **options)
    return placed.where(F.col("worker_id").isNotNull()).drop("cap_factor")


def backpressure_rows(df: DataFrame, key: str | Column, workers: DataFrame,
                      cap_factor: float, window: Column, **options) -> DataFrame:
    """(win, seq) of the rows no worker may take."""
    placed = place(df, key, workers, [cap_factor], window, **options)
    return placed.where(F.col("worker_id").isNull()).select("win", "seq")


def balanced_assign(df: DataFrame, workers: DataFrame, window: Column,
                    slice_rows: int = 1_000_000) -> DataFrame:
    """(win, seq, worker_id): rows dealt to the workers in turn."""
    hands = F.array(*[F.lit(w) for w, _ in fleet(workers)])
    rows = sliced_row_number(df.withColumn("win", window).select("win", "seq"), ["win"], ["seq"],
                             dense_slice("seq", slice_rows), "rn")
    turn = ((F.col("rn") - 1) % F.size(hands)).cast("int") + 1
    return rows.select("win", "seq", F.element_at(hands, turn).alias("worker_id"))


def shared_stem_key(chains: DataFrame, requests: DataFrame, text: str = "text",
                    min_support: int = 2, key: str = "seq") -> DataFrame:
    """(key, stem_key, stem_depth) of every request: the deepest chain hash that at least
    ``min_support`` requests share, else the first block; a text without a complete
    block has a hash of all of it, at depth 0. Feed ``stem_key`` to the placement."""
    support = chains.groupBy("chain_hash").agg(F.count(F.lit(1)).alias("support"))
    shared = F.when(F.col("support") >= min_support, F.struct("depth", "chain_hash"))
    first = F.when(F.col("depth") == 1, F.struct("depth", "chain_hash"))
    stems = (chains.join(support, "chain_hash")
             .groupBy(key).agg(F.coalesce(F.max(shared), F.max(first)).alias("s")))
    whole = F.md5(F.coalesce(F.col(text), F.lit("")))
    return (requests.select(key, whole.alias("__whole")).join(stems, key, "left")
            .select(key, F.coalesce("s.chain_hash", "__whole").alias("stem_key"),
                    F.coalesce("s.depth", F.lit(0)).alias("stem_depth")))
