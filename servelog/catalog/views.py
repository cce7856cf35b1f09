"""Request-log views over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from servelog.functions.keys import block_path, hash_api_key
from servelog.session import cut, prepare, scratch_path

DAY_US = 86_400_000_000
BLOCK_CHARS = 64
WORKERS = (("w0", ["m0", "m1"]), ("w1", ["m1", "m2"]), ("w2", ["m0"]), ("w3", ["m0", "m1"]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    k_text = k.cast("string")
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.format_string("req-%08d", "event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"), micros("ts").alias("ts_us"),
        user.alias("api_key"), F.concat(F.lit("m"), (user % 3).cast("string")).alias("model"),
        F.when(user % 10 == 0, "high").otherwise("default").alias("priority"),
        F.when(F.col("event_id") % 4 == 0, "async").otherwise("sync").alias("mode"),
        F.when(F.col("event_type") == "error", "error").otherwise("done").alias("status"),
        F.concat(F.lit("w"), (F.col("event_id") % 4).cast("string")).alias("worker_id"),
        k.alias("prefix_id"), F.md5(F.concat(F.lit("p"), k_text)).alias("prefix_hash"),
        (k * 100).alias("max_tokens"), (F.col("value") / 50).alias("temperature"),
        (k / F.lit(100.0)).alias("top_p"), k.cast("double").alias("queue_wait_ms"),
        F.col("value").alias("inference_ms"), (k + F.col("value")).alias("total_ms"),
        (k * 8 + 64).alias("prompt_tokens"),
        F.when(k % 3 == 0, k * 4 + 32).otherwise(0).alias("cached_tokens"),
        F.concat_ws(":", user.cast("string"), (k % 5).cast("string")).alias("idem_key"),
        "event_type", "props")


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").where("user_id % 7 <> 0").distinct()
    return users.select(hash_api_key("user_id").alias("key_hash"),
                        F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"),
                        F.lit(10).alias("rps_limit"))


def workers(spark: SparkSession) -> DataFrame:
    """The fleet: configuration of the placement queries."""
    rows = [F.struct(F.lit(w).alias("worker_id"), F.array(*map(F.lit, models)).alias("models"))
            for w, models in WORKERS]
    return prepare(spark).range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def supplier_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with one worker per supplier."""
    k = F.col("s_suppkey")
    model = [F.concat(F.lit("m"), ((k + i) % 5).cast("string")) for i in range(2)]
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("worker_id"), F.lit("mock").alias("engine"),
        F.array(*model).alias("models"), F.when(k % 2 == 0, 8).alias("max_batch"),
        F.when(k % 3 == 0, 4).alias("max_concurrent"), (k % 6).cast("int").alias("inflight"))


def prompt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), "text", F.col("lang").alias("worker_id"))


def prompt_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, worker_id, path_id, path): a hash of the whole text, its cumulative block hashes."""
    return prompt_log(spark, sf_dir).select(
        "seq", "worker_id", F.md5(F.coalesce("text", F.lit(""))).alias("path_id"),
        block_path("text", BLOCK_CHARS).alias("path"))


def prompt_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, worker_id, depth, chain_hash), one row per block."""
    return (prompt_paths(spark, sf_dir)
            .select("seq", "worker_id", F.posexplode("path").alias("pos", "chain_hash"))
            .select("seq", "worker_id", (F.col("pos") + 1).alias("depth"), "chain_hash"))


def prompt_chains_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prompt_chains`` from one evaluation of the block hashes, for plans that read them twice."""
    paths = cut(prompt_paths(spark, sf_dir).select("seq", "worker_id", "path"))
    return (paths.select("seq", "worker_id", F.posexplode("path").alias("pos", "chain_hash"))
            .select("seq", "worker_id", (F.col("pos") + 1).alias("depth"), "chain_hash"))


def token_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return rows.join(last, "conv_id").select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"),
        F.col("text").alias("token"), "role", (F.col("turn") == F.col("last")).alias("final"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).select(
        F.concat_ws(":", F.col("api_key").cast("string"), F.col("prefix_id").cast("string"))
        .alias("job_id"), "seq", "ts", "ts_us", F.col("event_type").alias("status"))


WORK_ORDER = ["day", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]


def work_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a log: WORK_ORDER is its total order, ``day`` its slice."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_no"), F.col("l_suppkey").alias("worker_id"),
        F.col("l_partkey").alias("prefix_id"), micros("l_shipdate").alias("ts_us"),
        F.col("l_quantity").alias("tokens"), (F.col("l_extendedprice") / 1000).alias("busy_ms"),
        F.floor(micros("l_shipdate") / DAY_US).alias("day"), "l_orderkey", "l_linenumber",
        "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(length, seed, policy, cap, p99) of a sweep, from the work log."""
    from servelog.plans.quantiles import exact_percentiles
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("length"), (F.col("l_suppkey") % 10).alias("seed"),
        F.col("l_returnflag").alias("policy"), F.col("l_linestatus").alias("cap"),
        (F.col("l_extendedprice") / 1000).alias("busy_ms"))
    return exact_percentiles(rows, ["length", "seed", "policy", "cap"], "busy_ms",
                             {"p99": 0.99}).drop("n")


def saved(df: DataFrame, name: str, fmt: str = "parquet") -> str:
    """Write a derived table to the shared folder; its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.format(fmt).save(path)
    return path
