"""Readers of the request log, the worker registry and request streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servelog.functions.keys import prefix_key
from servelog.sources import schemas


def read_log(spark: SparkSession, path: str, table: str, fmt: str = "parquet",
             **options: str) -> DataFrame:
    """``requests``, ``batches`` or ``api_keys`` with their fixed schema.

    ``fmt="jdbc"`` reads the same tables from a database; give ``url`` and, for a
    parallel read, ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``.
    """
    if table not in schemas.TABLES:
        raise ValueError(f"unknown table {table!r}")
    if fmt == "jdbc":
        df = spark.read.format("jdbc").options(dbtable=table, **options).load()
    else:
        df = (spark.read.format(fmt).options(**options)
              .schema(schemas.TABLES[table]).load(path))
    if table == "api_keys":
        df = df.withColumn("rps_limit",
                           F.coalesce("rps_limit", F.lit(schemas.DEFAULT_RPS_LIMIT)))
    return df


def read_workers(spark: SparkSession, path: str) -> DataFrame:
    """Worker registry; ``free_slots`` is what is left of ``max_concurrent``."""
    df = spark.read.schema(schemas.WORKERS).parquet(path)
    return with_worker_defaults(df)


def with_worker_defaults(workers: DataFrame) -> DataFrame:
    return (workers
            .withColumn("max_batch", F.coalesce("max_batch", F.lit(16)))
            .withColumn("max_concurrent", F.coalesce("max_concurrent", F.lit(1)))
            .withColumn("inflight", F.coalesce("inflight", F.lit(0)))
            .withColumn("free_slots",
                        F.greatest(F.lit(0), F.col("max_concurrent") - F.col("inflight"))))


def with_request_defaults(df: DataFrame) -> DataFrame:
    """Fill absent fields of a decoded request; derive a missing prefix hash."""
    filled = {name: F.coalesce(name, F.lit(default))
              for name, default in schemas.PARAM_DEFAULTS.items()}
    derived = F.when(F.coalesce("prefix_hash", F.lit("")) == "", prefix_key("input"))
    return df.withColumns({
        **filled,
        "priority": F.coalesce("priority", F.lit(schemas.DEFAULT_PRIORITY)),
        "prefix_hash": derived.otherwise(F.col("prefix_hash")),
    })


def read_request_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                        schema: str = schemas.REQUEST_EVENTS,
                        max_files: int | None = None) -> DataFrame:
    """Stream of request events with every absent field defaulted."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_request_defaults(reader.load(path))


def decode_kafka_requests(raw: DataFrame) -> DataFrame:
    """Request events from a Kafka source whose value is a JSON field map."""
    fields = F.from_json(F.col("value").cast("string"), schemas.REQUEST_EVENTS)
    return with_request_defaults(raw.select(fields.alias("r")).select("r.*"))


def read_calibration(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Measurement JSON -> its scalars and one (x, y) row per sample.

    ``multi_line`` reads one pretty-printed record per file; without it files
    hold a record per line and can be split.
    """
    raw = spark.read.schema(schemas.CALIBRATION).option("multiLine", multi_line).json(path)
    return (raw.withColumn("pair", F.explode("samples"))
            .withColumn("x", F.col("pair")[0]).withColumn("y", F.col("pair")[1])
            .drop("samples", "pair"))
