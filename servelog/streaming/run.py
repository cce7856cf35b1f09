"""Drive streaming plans to the end of the data that is there now."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from servelog.session import scratch_path

ROWS_PER_BATCH = 5_000_000


def _run(stream: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    if mode == "append":
        writer = writer.outputMode("append").format("parquet").option("path", out)
    else:
        def save(batch: DataFrame, epoch: int) -> None:
            # Rewriting an epoch's own folder makes a retry harmless.
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        writer = writer.outputMode(mode).foreachBatch(save)
    # AQE does not coalesce the shuffle of a stateful query, and its number of
    # state partitions is fixed for good: one per core unless fewer are asked for.
    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, min(int(before), stream.sparkSession.sparkContext.defaultParallelism))
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, before)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run with ``availableNow`` into a table in the shared folder; read it back."""
    spark: SparkSession = stream.sparkSession
    out = scratch_path(spark, name)
    _run(stream, out, scratch_path(spark, f"{name}-checkpoint"), mode)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def arrival_slices(df: DataFrame, order: str, at_least: int = 2,
                   rows: int = ROWS_PER_BATCH) -> list[Column]:
    """Predicates cutting ``df`` along ``order`` into micro-batches of bounded size."""
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("z"),
                  F.count(F.lit(1)).alias("n")).first()
    if not ends["n"]:
        return [F.lit(True)]
    parts = max(at_least, -(-ends["n"] // rows))
    width = -(-(ends["z"] - ends["a"] + 1) // parts)
    marks = [ends["a"] + i * width for i in range(parts)]
    return [(F.col(order) >= mark) & (F.col(order) < mark + width) for mark in marks]


def replay(inputs: Sequence[DataFrame], slices: Sequence[Column],
           plan: Callable[..., DataFrame], name: str, mode: str = "append") -> DataFrame:
    """Feed tables to a stream as they would arrive, one slice per micro-batch.

    Each slice is appended to the input folders and processed with the same
    checkpoint, so state carries over and no micro-batch holds the whole log. Inputs are
    read once, into a table partitioned by slice. Rows of no slice do not arrive.
    """
    spark = inputs[0].sparkSession
    number, number_field = F.lit(None).cast("int"), StructField("__slice", IntegerType())
    for k, part in reversed(list(enumerate(slices))):
        number = F.when(part, k).otherwise(number)
    staged = [scratch_path(spark, f"{name}-staged{i}") for i, _ in enumerate(inputs)]
    for df, folder in zip(inputs, staged):
        rows = df.withColumn("__slice", number).where("__slice IS NOT NULL")
        # Many files per slice: no task holds a whole one.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(parts, "__slice", F.xxhash64(*df.columns)).write.partitionBy("__slice").parquet(folder)
    folders = [scratch_path(spark, f"{name}-in{i}") for i, _ in enumerate(inputs)]
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    for k, _ in enumerate(slices):
        for df, source, folder in zip(inputs, staged, folders):
            table = spark.read.schema(StructType([*df.schema.fields, number_field])).parquet(source)
            table.where(F.col("__slice") == k).drop("__slice").write.mode("append").parquet(folder)
        stream = plan(*[spark.readStream.schema(df.schema).parquet(folder)
                        for df, folder in zip(inputs, folders)])
        _run(stream, out, checkpoint, mode)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)
