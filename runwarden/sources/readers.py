"""Files to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwarden import schemas

LIFECYCLE_TYPES = ["container", "network"]


def sensor_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Sensor lines (``raw``) of all files of a folder."""
    return spark.read.text(folder).withColumnRenamed("value", "raw").where(F.length(F.trim("raw")) > 0)


def stream_sensor_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The same as a stream with the file of each line as ``source_file``.

    The checkpoint of the query is the read position.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    lines = lines.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_file"))
    return lines.where(F.length(F.trim("raw")) > 0)


def keep_lifecycle_types(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(LIFECYCLE_TYPES))


def reread_overlap(events: DataFrame, cursor_us: int, overlap_seconds: int = 2) -> DataFrame:
    """Events from a little before the cursor on; repeats are removed by event id later."""
    return events.where(F.unix_micros("occurred_at") >= cursor_us - overlap_seconds * 1_000_000)


def trials(spark: SparkSession, folder: str, one_per_file: bool = True) -> DataFrame:
    """Completed trial records: one JSON document per file, or one per line."""
    rows = spark.read.schema(schemas.TRIAL).option("multiLine", one_per_file).json(folder)
    return rows.where("status = 'completed'")


def documents(spark: SparkSession, folder: str, schema: str, one_per_file: bool = True) -> DataFrame:
    """JSON documents of one of the known schemas: one per file, with the file as ``doc``, or one per line."""
    rows = spark.read.schema(schema).option("multiLine", one_per_file).json(folder)
    return rows.withColumn("doc", F.input_file_name()) if one_per_file else rows


def stored_documents(spark: SparkSession, folder: str, ids: str, schema: str) -> DataFrame:
    """Documents stored one per line under ``document``, next to the columns ``ids`` (DDL) that name them.

    That is how collected reports, component lists and feeds are kept; see ``sinks.store_documents``.
    A line whose document has another shape keeps its ids and has nulls.
    """
    rows = documents(spark, folder, f"{ids}, document STRUCT<{schema}>", one_per_file=False)
    return rows.select(*[c for c in rows.columns if c != "document"], "document.*")
