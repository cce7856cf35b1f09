"""Session settings and the shared scratch folder for intermediate tables."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on. Skewed joins are left to AQE, and
# splitting a hot key is worth an extra shuffle further down the plan.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. A local session that names
    none gets a temporary folder; anything else is refused, since executors
    would not see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if not root and current:
        root = current.rsplit("/", 1)[0]
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="servelog-")
    if not current:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of the queries run meanwhile are removed as each ends."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from that table.

    Unlike a checkpointed RDD, a table is pruned by column when read and tells
    the optimizer its size, so a small one is broadcast and a large one is not.
    A lost executor costs a re-read. Once the table is written, nothing reads the shuffle files it
    was made from: they go at once, not whenever the driver collects its garbage.
    """
    path = scratch_path(df.sparkSession, "cut")
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
