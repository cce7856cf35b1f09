"""Lookups: authentication, batches, model placement, paths, un-acked rows.

No join here forces a broadcast: Catalyst broadcasts a side whose measured size
is under ``spark.sql.autoBroadcastJoinThreshold`` and AQE splits skewed keys of
the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def authenticate(requests: DataFrame, api_keys: DataFrame,
                 key: str = "key_hash") -> tuple[DataFrame, DataFrame]:
    """(accepted with tenant_id and rps_limit, rejected), two filters of one left join."""
    known = api_keys.select(key, "tenant_id", "rps_limit", F.lit(True).alias("__known"))
    looked = requests.join(known, key, "left")
    return (looked.where("__known").drop("__known"),
            looked.where("__known IS NULL").drop("__known", "tenant_id", "rps_limit"))


def requests_with_batches(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """Attach size, worker and inference time of the batch; keep all requests."""
    side = batches.select(F.col("id").alias("batch_id"), F.col("size").alias("batch_size"),
                          F.col("worker_id").alias("batch_worker_id"),
                          F.col("inference_ms").alias("batch_inference_ms"))
    return requests.join(side, "batch_id", "left")


def worker_models(workers: DataFrame) -> DataFrame:
    """One row per (model, worker)."""
    return workers.select(F.explode("models").alias("model"), "worker_id").distinct()


def models_loaded_on(workers: DataFrame) -> DataFrame:
    return (worker_models(workers).groupBy("model")
            .agg(F.sort_array(F.collect_list("worker_id")).alias("workers")))


def capable_workers(requests: DataFrame, workers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request x worker holding its model, requests no worker can serve), two filters of one
    left join. Where the pairs are not needed, take ``is_servable``."""
    looked = requests.join(worker_models(workers), "model", "left")
    return (looked.where("worker_id IS NOT NULL"),
            looked.where("worker_id IS NULL").drop("worker_id"))


def is_servable(requests: DataFrame, workers: DataFrame) -> DataFrame:
    """Requests with ``servable``: some worker holds the model. A row per request."""
    loaded = worker_models(workers).select("model", F.lit(True).alias("servable")).distinct()
    return requests.join(loaded, "model", "left").withColumn(
        "servable", F.coalesce("servable", F.lit(False)))


def path_owners(paths: DataFrame, eligible: DataFrame | None = None,
                by: tuple[str, ...] = ()) -> DataFrame:
    """Warmest worker per chain hash: the eligible one that used it last.

    ``paths(chain_hash, worker_id, last_seq)`` may hold many rows per hash; the
    result holds one, so a stem every request shares does not fan out.
    """
    if eligible is not None:
        paths = paths.join(eligible.select("worker_id").distinct(), "worker_id", "left_semi")
    last = paths.groupBy(*by, "chain_hash", "worker_id").agg(F.max("last_seq").alias("last_seq"))
    return (last.groupBy(*by, "chain_hash")
            .agg(F.max(F.struct("last_seq", "worker_id")).alias("o"))
            .select(*by, "chain_hash", F.col("o.worker_id").alias("worker_id"),
                    F.col("o.last_seq").alias("last_seq")))


def longest_prefix_match(chains: DataFrame, paths: DataFrame,
                         eligible: DataFrame | None = None,
                         is_eligible: Column | None = None,
                         key: str = "seq") -> DataFrame:
    """(key, worker_id, matched_blocks): deepest shared block prefix.

    ``chains(key, depth, chain_hash)`` are the requests' block chains. Equal
    depth goes to the most recently used worker. Requests without a match are
    absent; left-join them back for (NULL, 0). ``is_eligible`` is a Column over
    the worker columns of ``eligible``.
    """
    if eligible is not None and is_eligible is not None:
        eligible = eligible.where(is_eligible)
    owners = path_owners(paths, eligible).select("chain_hash", "worker_id")
    return (chains.join(owners, "chain_hash")
            .groupBy(key).agg(F.max(F.struct("depth", "worker_id")).alias("m"))
            .select(key, F.col("m.worker_id").alias("worker_id"),
                    F.col("m.depth").alias("matched_blocks")))


def unacked_after(deliveries: DataFrame, acks: DataFrame, now: Column,
                  lease_s: float = 30.0, limit: int = 64, key: str = "request_id",
                  ts_us: str = "ts_us") -> DataFrame:
    """Oldest ``limit`` deliveries without ack that are idle for the lease."""
    idle = now - F.col(ts_us) >= F.lit(int(lease_s * 1_000_000))
    return (deliveries.where(idle).join(acks.select(key), key, "left_anti")
            .orderBy(ts_us, key).limit(limit))
