"""Sinks: sweep tables as CSV, the request log as a partitioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_sweep_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_request_log(stream: DataFrame, path: str, checkpoint: str,
                      ts: str = "created_at", **trigger) -> StreamingQuery:
    """Append a stream of finished requests, partitioned by model and day.

    The file sink commits each micro-batch once, so a restart neither loses nor
    repeats rows. Partition pruning answers the by-model-and-time lookups.
    """
    return (stream.withColumn("day", F.to_date(ts))
            .writeStream.format("parquet").outputMode("append")
            .partitionBy("model", "day")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
