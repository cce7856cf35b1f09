"""Session settings of the corpus operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

from servelog.session import prepare

#: Texts per Arrow batch: few enough that a Python worker holds some megabytes of text.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return prepare(spark)
