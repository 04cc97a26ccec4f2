"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the time zone and adaptive execution on a session that exists already."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("runwarden")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    return builder.config("spark.ui.enabled", "false").getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster; a fresh local one only in local mode when none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        return folder
    existing = context.getCheckpointDir()
    if existing:
        return existing
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="run-ckpt-")
    context.setCheckpointDir(folder)
    return folder


def bound_batches(spark: SparkSession) -> None:
    """Let tasks hand rows to their Python workers in batches of some 3 MB instead of 64 MB.

    A batch is held on both sides, by the worker two times while it is replaced, so its size counts
    several times in an executor's memory.  No result depends on it.  The setting stays, since a
    plan reads it only when it runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "3m")


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and read it back.

    For intermediate results that are small next to the events and are read by several
    later steps.  Runs a job.  The table survives lost executors, later readers prune
    its columns, and its real size guides their joins.  The shuffle files that made the
    table are removed as soon as it is written; a later loss is read from the table.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(folder)
