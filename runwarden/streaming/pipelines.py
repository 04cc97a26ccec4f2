"""Structured Streaming forms of the operators.

Steps that need joins with history run inside ``foreachBatch`` on the batch operators, with
the history in Parquet tables, so that a stream and a batch run give the same rows.
Deduplication, windows and scores are in ``window_log``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runwarden import config
from runwarden.operators import enrich, incidents, normalize
from runwarden.operators.ordering import TIME_STEP
from runwarden.sources import sinks
from runwarden.sources.merge_table import MergeTable, first_of_key


def start(
    frame: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run a stream until its present input is used up, batch by batch."""
    writer = frame.writeStream.outputMode(mode).foreachBatch(each)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def source_of(checkpoint: str) -> str:
    """Name of a query among those that commit to a table."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def stored(spark: SparkSession, path: str, key: str) -> MergeTable:
    """Table of rows of which the first one of each key counts."""
    return MergeTable(spark, path, first_of_key([key]))


# --- ingest ------------------------------------------------------------------------------


def normalise_stream(
    lines: DataFrame, sensor_id: str, rule: str, host_id: str | None, events: str, letters: str, checkpoint: str
) -> StreamingQuery:
    """Raw lines to an event table and a dead-letter table, both merge tables.

    Every rejected line is a letter of its own, equal ones too.  A replay of the same
    files, or of the same batch where the lines have no ``source_file``, adds none.  Read
    them with :func:`stored`.
    """
    spark, source = lines.sparkSession, source_of(checkpoint)
    event_table, letter_table = stored(spark, events, "event_id"), stored(spark, letters, "letter_id")

    def each(batch: DataFrame, batch_id: int) -> None:
        if "source_file" not in batch.columns:
            batch = batch.withColumn("source_file", F.lit(f"batch {batch_id}"))
        good, bad = normalize.normalize_exec_lines(batch, sensor_id, rule, host_id)
        event_table.commit(good.drop("raw_event"), source, batch_id)
        letter_table.commit(normalize.number_letters(bad), source, batch_id)

    return start(lines, each, checkpoint)


# --- joins with history ------------------------------------------------------------------


_SEEN = "container_id string, event_id string, us bigint, is_shell boolean, day bigint, batch bigint"


def _days(rows: DataFrame, width: int) -> list[int]:
    """Days on which rows can meet others: shells later ones, tools earlier ones."""
    first = F.when(F.col("is_shell"), F.col("us")).otherwise(F.col("us") - width)
    last = F.when(F.col("is_shell"), F.col("us") + width).otherwise(F.col("us"))
    days = F.sequence(F.floor(first / TIME_STEP), F.floor(last / TIME_STEP))
    return sorted(r[0] for r in rows.select(F.explode(days)).distinct().collect())


def shell_then_tool_stream(
    shells: DataFrame,
    tools: DataFrame,
    history: str,
    pairs: str,
    checkpoint: str,
    seconds: int = config.CORRELATION_SECONDS,
) -> StreamingQuery:
    """Tools within some seconds after a shell of their container, however late either arrives.

    There is no watermark.  Rows are kept below ``history`` by day; a batch reads only the days its
    rows can meet, and joins new shells with all tools and old shells with new tools.  Pairs of a
    batch are a folder of their own below ``pairs``; read them with :func:`shell_tool_pairs`.  A
    batch that is repeated writes the same folders again.  Rows without container or time meet nothing.
    """
    width = seconds * 1_000_000

    def side(rows: DataFrame, is_shell: bool) -> DataFrame:
        return rows.select("container_id", "event_id", F.unix_micros("occurred_at").alias("us"), F.lit(is_shell).alias("is_shell"))

    def named(rows: DataFrame, kind: str) -> DataFrame:
        chosen = rows.where("is_shell" if kind == "shell" else "NOT is_shell")
        return chosen.select("container_id", F.col("event_id").alias(f"{kind}_event_id"), F.col("us").alias(f"{kind}_us"))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, day = batch.sparkSession, F.floor(F.col("us") / TIME_STEP)
        rows = batch.dropna(subset=["container_id", "us"]).withColumns({"day": day, "batch": F.lit(batch_id).cast("bigint")})
        # Dynamic: a repeated batch replaces its own folders and no other.
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch").parquet(history)
        mine = f"batch={batch_id}"
        written = sinks.matching(spark, f"{history}/day=*/{mine}")
        if not written:
            return
        reader = spark.read.schema(_SEEN).option("basePath", history)
        new = reader.parquet(*written)
        days = {f"day={d}" for d in _days(new, width)}
        near = [path for path in sinks.matching(spark, f"{history}/day=*") if path.rsplit("/", 1)[1] in days]
        known = reader.parquet(*near).where(F.col("batch") <= batch_id)
        old = known.where(F.col("batch") < batch_id)

        def join(left: DataFrame, right: DataFrame) -> DataFrame:
            met = enrich.within_seconds_after(named(left, "shell"), named(right, "tool"), ["container_id"], seconds, "shell_us", "tool_us")
            return met.select("container_id", "shell_event_id", "tool_event_id")

        found = join(new, known).unionByName(join(old, new))
        found.write.mode("overwrite").parquet(f"{pairs}/{mine}")

    return start(side(shells, True).unionByName(side(tools, False)), each, checkpoint)


def shell_tool_pairs(spark: SparkSession, pairs: str) -> DataFrame:
    """(container_id, shell_event_id, tool_event_id) of all batches, once each also where events were repeated."""
    schema = "container_id string, shell_event_id string, tool_event_id string, batch bigint"
    return spark.read.schema(schema).parquet(pairs).drop("batch").distinct()


def identity_table(spark: SparkSession, path: str) -> MergeTable:
    """Mergeable states of containers; ``enrich.identity_view`` shows what they say."""
    return MergeTable(spark, path, _merge_identities)


def _merge_identities(states: DataFrame) -> DataFrame:
    merged = enrich.merge_identity_state(states.drop("_commit"))
    return merged.withColumn("_commit", F.lit(0).cast("bigint"))


def identity_stream(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Latest container state: every batch commits the state of its own events and reads no other."""
    states, source = identity_table(events.sparkSession, table), source_of(checkpoint)
    return start(events, lambda batch, batch_id: states.commit(enrich.identity_state(batch), source, batch_id) and None, checkpoint)


def alert_stream(opened: DataFrame, notified: str, minimum: str, checkpoint: str) -> StreamingQuery:
    """Incidents to tell somebody about, committed to a merge table in which the first alert of each stays.

    A batch reads nothing stored.  Read the table with ``stored(spark, notified, "incident_id")``.
    """
    told, source = stored(opened.sparkSession, notified, "incident_id"), source_of(checkpoint)
    return start(opened, lambda batch, batch_id: told.commit(incidents.alert_worthy(batch, minimum), source, batch_id) and None, checkpoint)
