"""Spark session defaults, shared scratch space and the size bounds used by the package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A side of a join is broadcast only when its row count was measured and lies
# under this bound; larger sides take the ordinary shuffle join.
BROADCAST_ROWS = 100_000
# Rows a report, vocabulary or sample may hold on the driver.
DRIVER_ROWS = 100_000
# Most slices an ordered computation is cut into (their summaries are broadcast).
MAX_SLICES = 8_192
# Spark's setting under which the shuffle files of a finished execution are removed.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and a fixed time zone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session inside one JVM (``local`` or ``local[n]``) without that setting gets a
    folder of its own; on a cluster, ``local-cluster`` included, a missing setting is
    an error, since a machine-local folder would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/tablewright/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy.

    The shuffle files of the write go when it ends: only a recomputed task of the same write reads them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text file through Spark, so that any file system works."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()["value"].rstrip("\n")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on the file system that Spark would read it from."""
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1).count()
        return True
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
