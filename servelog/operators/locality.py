"""Cache locality of an access log: hits, reuse distances, shared block paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servelog.plans.dominance import POSITIONS_PER_SLICE, distinct_between
from servelog.plans.joins import null_safe_join, solid
from servelog.plans.sliced import dense_slice, even_slice, sliced_lag, sliced_row_number
from servelog.session import cut

# Latency law of a batch in milliseconds, cache size in prefixes.
ALPHA_MS, BETA_MS, PREFILL_MS = 18.0, 7.5, 160.0
CACHE_CAPACITY = 64
SLICE_BLOCKS = 250_000
# A key with more accesses than HOT_ACCESSES is searched in slices of as many positions;
# one access in SAMPLE tells which keys these are.
HOT_ACCESSES, SAMPLE = 250_000, 64


def first_touch(df: DataFrame, by: Sequence[str], order: str = "seq") -> DataFrame:
    """``hit`` under an unbounded cache: some earlier row has the same keys.

    The first rows are written: where keys are few, their true size spares a shuffle of ``df``.
    """
    first = cut(df.groupBy(*by).agg(F.min(order).alias("__first")))
    return (null_safe_join(df, first, list(by)).withColumn("hit", F.col(order) > F.col("__first"))
            .drop("__first"))


def access_positions(df: DataFrame, worker: Sequence[str], key: str, order: Sequence,
                     slice_: Column) -> DataFrame:
    """Add ``pos`` (1.. per worker) and ``prev`` (position of the previous
    access to the same key, 0 if none)."""
    rows = sliced_row_number(df, worker, order, slice_, "pos")
    rows = sliced_lag(rows, [*worker, key], ["pos"], dense_slice("pos"), ["pos"], "__p")
    return rows.withColumn("prev", F.coalesce(F.col("__p.pos"), F.lit(0))).drop("__p")


def reuse_distance(df: DataFrame, worker: str, key: str, order: Sequence, slice_: Column,
                   slice_positions: int = POSITIONS_PER_SLICE) -> DataFrame:
    """Add ``distance``: distinct keys of the worker touched since the previous
    access to this key; NULL for a first access."""
    rows = cut(access_positions(df, [worker], key, order, slice_).withColumn("__grp", solid(worker)))
    points = rows.select(F.col("__grp").alias("grp"), "pos", "prev")
    asks = points.where("prev > 0").select("grp", F.col("pos").alias("query"),
                                           F.col("prev").alias("p"), F.col("pos").alias("j"))
    found = (distinct_between(points, asks, slice_positions)
             .select(F.col("grp").alias("__grp"), F.col("query").alias("pos"), "distance"))
    return rows.join(found, ["__grp", "pos"], "left").drop("__grp")


def lru_hits(df: DataFrame, capacity: int, worker: str = "worker_id",
             key: str = "prefix_hash", order: Sequence = ("seq",),
             slice_: Column | None = None, **options) -> DataFrame:
    """``hit`` of an exact LRU cache of ``capacity`` keys per worker."""
    slice_ = dense_slice(order[0]) if slice_ is None else slice_
    rows = reuse_distance(df, worker, key, order, slice_, **options)
    return rows.withColumn("hit", F.coalesce(F.col("distance") < capacity, F.lit(False)))


def miss_ratio_curve(distances: DataFrame, capacities: Sequence[int],
                     by: Sequence[str] = ()) -> DataFrame:
    """(by…, capacity, hit_ratio, miss_ratio) from one pass over distances."""
    hits = [F.count_if(F.col("distance") < c).alias(f"c{c}") for c in capacities]
    per = distances.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *hits)
    points = F.array(*[F.struct(F.lit(c).alias("capacity"), F.col(f"c{c}").alias("hits"))
                       for c in capacities])
    ratio = F.col("hits") / F.col("n")
    return (per.select(*by, "n", F.inline(points))
            .select(*by, "capacity", ratio.alias("hit_ratio"), (1 - ratio).alias("miss_ratio")))


def batch_hits(df: DataFrame, capacity: int | None = None, worker: str = "worker_id",
               key: str = "prefix_id", batch: str = "batch_no", order: Sequence = ("batch_no",),
               slice_: Column | None = None) -> DataFrame:
    """``hit`` judged at batch start: the key was resident before the batch.

    ``order`` orders a worker's rows and must keep a batch together. Without a
    capacity that is "an earlier batch touched it"; with one, fewer than
    ``capacity`` distinct keys were touched since its last access before the
    batch.
    """
    if capacity is None:
        first = df.groupBy(worker, key).agg(F.min(batch).alias("__first"))
        return (null_safe_join(df, first, [worker, key])
                .withColumn("hit", F.col(batch) > F.col("__first")).drop("__first"))
    slice_ = dense_slice(batch) if slice_ is None else slice_
    rows = cut(sliced_row_number(df, [worker], order, slice_, "pos"))
    placed = rows.select(solid(worker).alias("__grp"), F.col(key).alias("__key"),
                         F.col(batch).alias("__batch"), "pos")
    seen = cut(_repeats(placed))
    starts = placed.groupBy("__grp", "__batch").agg(F.min("pos").alias("j"))
    # Only a batch's first access to a key looks back beyond the batch.
    asks = cut(seen.where("pos = head").join(starts, ["__grp", "__batch"])
               .select(F.col("__grp").alias("grp"), F.col("pos").alias("query"), F.col("prev").alias("p"), "j"))
    points = seen.select(F.col("__grp").alias("grp"), "pos", "prev")
    near = (distinct_between(points, asks).where(F.col("distance") < capacity)
            .select(F.col("grp").alias("__grp"), F.col("query").alias("head")))
    near = cut(seen.join(near, ["__grp", "head"]).select("__grp", "pos", F.lit(True).alias("__near")))
    return (rows.where(F.col(batch).isNotNull()).withColumn("__grp", solid(worker))
            .join(near, ["__grp", "pos"], "left")
            .withColumn("hit", F.coalesce("__near", F.lit(False))).drop("__grp", "pos", "__near"))


def _repeats(placed: DataFrame) -> DataFrame:
    """(__grp, __batch, pos, prev, head) of the accesses to keys that their worker has had before.

    ``placed(__grp, __key, __batch, pos)``; ``prev`` is the position of the access before,
    ``head`` that of the batch's first access to the key. Keys are shuffled once; only hot ones are
    cut into slices, which get the last access of the slice before as one more row.
    """
    key = ["__grp", "__key"]
    hot = (placed.where(F.xxhash64("pos") % SAMPLE == 0).groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
           .where(F.col("__n") > HOT_ACCESSES // SAMPLE).select(*key, F.lit(True).alias("__hot")))
    rows = null_safe_join(placed, F.broadcast(cut(hot)), key, "left")
    rows = rows.withColumn("__s", F.when(F.col("__hot"), dense_slice("pos", HOT_ACCESSES)).otherwise(-1))
    runs = (rows.where("__hot").groupBy(*key, "__batch", "__s")
            .agg(F.min("pos").alias("__from"), F.max("pos").alias("pos"))
            .withColumn("__from", F.min("__from").over(Window.partitionBy(*key, "__batch"))))
    before = (runs.groupBy(*key, "__s").agg(F.max_by(F.struct("__batch", "pos", "__from"), "pos").alias("__e"))
              .withColumn("__e", F.lag("__e").over(Window.partitionBy(*key).orderBy("__s")))
              .where(F.col("__e").isNotNull()).select(*key, "__s", "__e.*"))
    here = Window.partitionBy(*key, "__s").orderBy("pos")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("__p").isNull() | ~F.col("__p.__batch").eqNullSafe(F.col("__batch"))
    head = F.coalesce("__from", F.when(opens, F.col("pos")))
    return (rows.drop("__hot").unionByName(before, allowMissingColumns=True)
            .withColumn("__p", F.lag(F.struct("__batch", "pos")).over(here))
            .withColumn("head", F.last(head, True).over(upto))
            .where(F.col("__from").isNull() & F.col("__p").isNotNull())
            .select("__grp", "__batch", "pos", F.col("__p.pos").alias("prev"), "head"))


def batch_locality(df: DataFrame, capacity: int | None = None, worker: str = "worker_id",
                   key: str = "prefix_id", batch: str = "batch_no", **options) -> DataFrame:
    """(worker, batch, size, hits, distinct_missed) per batch."""
    rows = batch_hits(df, capacity, worker, key, batch, **options)
    return rows.groupBy(worker, batch).agg(
        F.count(F.lit(1)).alias("size"), F.count_if("hit").alias("hits"),
        F.count_distinct(F.when(~F.col("hit"), F.col(key))).alias("distinct_missed"))


def batch_cost(batches: DataFrame, alpha: float = ALPHA_MS, beta: float = BETA_MS,
               prefill: float = PREFILL_MS, workers: int = 1, slots: int = 1) -> DataFrame:
    """Latency law per batch and the throughput it implies."""
    size, base = F.col("size"), F.lit(alpha) + F.lit(beta) * F.col("size")
    capacity = workers * slots * 1000.0 / (alpha + beta + prefill)
    return (batches
            .withColumn("latency_ms", F.when(size == 0, F.lit(0.0))
                        .otherwise(base + F.lit(prefill) * F.col("distinct_missed")))
            .withColumn("throughput_rps", F.lit(1000.0) * size / base)
            .withColumn("capacity_rps", F.lit(capacity))
            .withColumn("offered_rps", F.lit(max(1.0, round(0.75 * capacity, 3)))))


def retained_paths(served: DataFrame, capacity: int = 0, worker: str = "worker_id",
                   path: str = "path_id", order: str = "seq") -> DataFrame:
    """(worker, path, last_seq): the ``capacity`` paths a worker served last.

    ``row_number() <= capacity`` is limited map-side before the shuffle, so a
    worker's task gets at most ``capacity`` rows per input partition.
    """
    last = served.groupBy(worker, path).agg(F.max(order).alias("last_seq"))
    if capacity <= 0:
        return last
    recent = Window.partitionBy(worker).orderBy(F.desc("last_seq"))
    return (last.withColumn("__rn", F.row_number().over(recent))
            .where(F.col("__rn") <= capacity).drop("__rn"))


def prefix_trie(served: DataFrame, capacity: int = 0) -> DataFrame:
    """Trie as a table: (depth, chain_hash, parent_hash, worker_id, refcount, last_seq).

    ``served(seq, worker_id, path_id, path)``: ``path_id`` names the whole prompt, e.g. by a
    hash of all its text, ``path`` holds its cumulative block hashes and may be empty.
    ``refcount`` counts a worker's retained distinct paths through a node. Owners, path
    and node counts are filters on the result.
    """
    kept = retained_paths(served, capacity)
    # The blocks of one path are equal wherever it was served.
    blocks = (served.groupBy("path_id").agg(F.first("path").alias("path")))
    nodes = (kept.join(blocks, "path_id")
             .select("worker_id", "last_seq", "path", F.posexplode("path").alias("d", "chain_hash")))
    parent = F.when(F.col("d") > 0, F.element_at("path", F.greatest(F.col("d"), F.lit(1))))
    return (nodes.select("worker_id", "last_seq", (F.col("d") + 1).alias("depth"), "chain_hash",
                         parent.alias("parent_hash"))
            .groupBy("depth", "chain_hash", "parent_hash", "worker_id")
            .agg(F.count(F.lit(1)).alias("refcount"), F.max("last_seq").alias("last_seq")))


def reuse_depth(chains: DataFrame, lengths: DataFrame, by: Sequence[str] = ("worker_id",),
                key: str = "seq") -> DataFrame:
    """(by…, key, n_blocks, reused, reuse_fraction) under an unbounded cache.

    ``chains(by…, key, depth, chain_hash)``; ``lengths(by…, key, n_blocks)`` keeps
    requests that have no complete block.
    """
    first = chains.groupBy(*by, "chain_hash").agg(F.min(key).alias("__first"))
    reused = (chains.join(first, [*by, "chain_hash"]).where(F.col(key) > F.col("__first"))
              .groupBy(*by, key).agg(F.count(F.lit(1)).alias("reused")))
    n = F.coalesce("reused", F.lit(0))
    return (lengths.join(reused, [*by, key], "left")
            .select(*by, key, "n_blocks", n.alias("reused"),
                    F.when(F.col("n_blocks") > 0, n / F.col("n_blocks"))
                    .otherwise(F.lit(0.0)).alias("reuse_fraction")))


def reuse_depth_lru(chains: DataFrame, lengths: DataFrame, capacity: int,
                    worker: str = "worker_id", key: str = "seq",
                    slice_: Column | None = None) -> DataFrame:
    """(worker, key, n_blocks, reused, reuse_fraction) when a worker keeps the ``capacity`` blocks
    used last.

    A request touches its blocks in order; those that were resident when it came count up to
    the first that was not. That is ``batch_hits`` with a request as the batch. Slices hold
    equal numbers of blocks: requests have from none to thousands.
    """
    slice_ = even_slice(chains, key, SLICE_BLOCKS) if slice_ is None else slice_
    rows = batch_hits(chains, capacity, worker, "chain_hash", key, [key, "depth"], slice_)
    miss = F.min(F.when(~F.col("hit"), F.col("depth"))) - 1
    depth = rows.groupBy(worker, key).agg(F.coalesce(miss, F.max("depth")).alias("reused"))
    n = F.coalesce("reused", F.lit(0)).cast("long")
    return null_safe_join(lengths, depth, [worker, key], "left").select(
        worker, key, "n_blocks", n.alias("reused"),
        F.when(F.col("n_blocks") > 0, n / F.col("n_blocks")).otherwise(F.lit(0.0)).alias("reuse_fraction"))


def cache_hit_ratio(df: DataFrame, by: Sequence[str], hit: str = "hit") -> DataFrame:
    flag = F.col(hit)
    return df.groupBy(*by).agg(
        F.count_if(flag).alias("hits"), F.count_if(~flag).alias("misses"),
        F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)).alias("hit_ratio"))


def token_hit_fraction(df: DataFrame, by: Sequence[str],
                       ok: Column | None = None) -> DataFrame:
    rows = df.where(F.col("prompt_tokens") > 0)
    rows = rows if ok is None else rows.where(ok)
    fraction = F.sum("cached_tokens") / F.sum("prompt_tokens")
    return rows.groupBy(*by).agg(F.sum("cached_tokens").alias("cached_tokens"),
                                 F.sum("prompt_tokens").alias("prompt_tokens"),
                                 F.coalesce(fraction, F.lit(0.0)).alias("token_hit_fraction"))


def workers_per_prefix(df: DataFrame, by: Sequence[str] = (), prefix: str = "prefix_hash",
                       worker: str = "worker_id", approximate: bool = False) -> DataFrame:
    """Mean over prefixes of the workers that served each."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    per = df.groupBy(*by, prefix).agg(count(F.col(worker)).alias("w"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_prefixes"),
                                F.avg("w").alias("workers_per_prefix"))


def stem_of(path: str = "path", blocks: int = 3) -> Column:
    """Key of the first ``blocks`` blocks of a path (all of a shorter one)."""
    depth = F.least(F.size(path), F.lit(blocks))
    return F.when(depth > 0, F.element_at(path, F.greatest(depth, F.lit(1))))
