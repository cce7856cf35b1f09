from pyspark.sql import SparkSession

from servelog.session import prepare


def local_session(cpus="8", partitions="8"):
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("servelog-tests")
             .config("spark.sql.shuffle.partitions", partitions)
             .config("spark.driver.memory", "6g")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
