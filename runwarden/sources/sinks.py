"""DataFrames to files, and checks of what was written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, target: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of a batch that are neither in the target nor repeated in the batch."""
    return batch.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def append_counts(batch: DataFrame, target: DataFrame, key: str = "event_id") -> DataFrame:
    """received, inserted and duplicates of an idempotent append."""
    received = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = target.select(key).distinct().withColumn("_known", F.lit(True))
    marked = received.join(known, key, "left")
    return marked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("received"),
        F.count_if(F.col("_known").isNull()).alias("inserted"),
    ).withColumn("duplicates", F.col("received") - F.col("inserted"))


def append_new(
    batch: DataFrame, path: str, key: str = "event_id", time: str | None = None, partition: str | None = None
) -> None:
    """Idempotent append to a Parquet table, usable from ``foreachBatch``.

    With ``time``, a column that is the same for every copy of a key, only the stored rows
    in the time range of the batch are read, so a batch does not cost more as the table
    grows.
    """
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key])
    if exists(spark, path):
        stored = spark.read.parquet(path)
        if time is not None:
            first, last = batch.agg(F.min(time), F.max(time)).first()
            if first is None:
                return
            stored = stored.where(F.col(time).between(F.lit(first), F.lit(last)))
        rows = rows.join(stored.select(key), key, "left_anti")
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all below it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def write_summary(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], kind: str = "csv") -> None:
    """Sorted rows with fixed columns as CSV with header or as JSON lines."""
    rows = df.select(*columns).orderBy(*order)
    if kind == "csv":
        rows.write.mode("errorifexists").option("header", True).csv(path)
    else:
        rows.write.mode("errorifexists").json(path)


def store_documents(rows: DataFrame, path: str, document: str = "document") -> None:
    """Rows with a JSON text as compressed JSON lines in which the text is part of the line, not quoted in it.

    Null documents are stored as null.
    """
    ids = F.to_json(F.struct(*[c for c in rows.columns if c != document]))
    body = F.coalesce(F.col(document), F.lit("null"))
    rows.select(ids.alias("ids"), document).select(
        F.concat(
            F.expr("substr(ids, 1, length(ids) - 1)"), F.when(F.col("ids") == "{}", "").otherwise(","),
            F.lit('"document":'), body, F.lit("}"),
        )
    ).write.mode("errorifexists").option("compression", "gzip").text(path)


def differences(recomputed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows only in one of two tables, with multiplicity; empty when a replay agrees."""
    left = recomputed.exceptAll(recorded).withColumn("side", F.lit("recomputed"))
    return left.unionByName(recorded.exceptAll(recomputed).withColumn("side", F.lit("recorded")))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size_bytes) of every file below a folder, path relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = "^.*?" + folder.rstrip("/").replace(".", r"\.") + "/"
    return files.select(
        F.regexp_replace("path", root, "").alias("path"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size_bytes"),
    )


def verify_manifest(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem): missing, mismatched and unrecorded files."""
    c, m = current.alias("c"), manifest.alias("m")
    joined = m.join(c, F.col("m.path") == F.col("c.path"), "full_outer")
    problem = (
        F.when(F.col("c.path").isNull(), "missing")
        .when(F.col("m.path").isNull(), "unrecorded")
        .when(F.col("m.sha256") != F.col("c.sha256"), "mismatch")
    )
    return joined.select(F.coalesce("m.path", "c.path").alias("path"), problem.alias("problem")).where(
        "problem IS NOT NULL"
    )
