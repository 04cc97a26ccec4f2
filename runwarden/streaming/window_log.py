"""Windows of a stream as a log of mergeable changes, so that no row is too late.

A watermark closes windows and drops what comes afterwards.  Here every batch adds the
changes it makes to the counts of its windows, and the windows it touched get a new
revision.  Readers take the latest revision; a late row makes one more.  Four tables, each
partitioned by batch and window:

events      first copies of the events, with ``late``: a window with a later end was
            already revised when the event came
changes     ``image_digest, family, token, n``; ``n`` is negative where a late event came
            between two neighbours of a sequence
scores      score, components and band of every revised window, if there is a baseline

A batch reads only the windows it touches.  It writes under its own number and sees only
smaller numbers, so a batch that is repeated after a failure writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from runwarden import config
from runwarden.operators import profile, score
from runwarden.session import materialize
from runwarden.sources import sinks
from runwarden.streaming.pipelines import start

EXEC_COLUMNS = ("image_digest", "container_id", "event_id", "occurred_at", "process_name", "executable",
                "parent_name", "parent_executable", "user_uid")
LIFECYCLE_COLUMNS = ("image_digest", "container_id", "event_id", "occurred_at", "event_type", "action")
WINDOW = ["image_digest", "w"]


def feed(execs: DataFrame, lifecycle: DataFrame | None = None) -> DataFrame:
    """Executions and lifecycle events as one stream; ``is_exec`` tells them apart."""
    rows = execs.select(F.lit(True).alias("is_exec"), *EXEC_COLUMNS)
    if lifecycle is None:
        return rows.withColumns({c: F.lit(None).cast("string") for c in ("event_type", "action")})
    other = lifecycle.select(F.lit(False).alias("is_exec"), *LIFECYCLE_COLUMNS)
    return rows.unionByName(other, allowMissingColumns=True)


class WindowLog:
    """The tables of one stream below ``folder``; windows of ``width_us`` anchored at ``anchor_us``."""

    def __init__(self, spark: SparkSession, folder: str, width_us: int, anchor_us: int = 0):
        self.spark, self.folder, self.width_us, self.anchor_us = spark, folder, width_us, anchor_us

    def _window(self) -> Column:
        return F.floor((profile.micros(F.col("occurred_at")) - self.anchor_us) / self.width_us).cast("bigint")

    def _read(self, table: str, before: int | None, windows: Sequence[int] | None, schema: StructType | None = None) -> DataFrame | None:
        path = f"{self.folder}/{table}"
        if not sinks.exists(self.spark, path):
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.parquet(path).withColumns({"batch": F.col("batch").cast("bigint"), "w": F.col("w").cast("bigint")})
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        return rows if windows is None else rows.where(F.col("w").isin(list(windows)))

    def _write(self, rows: DataFrame, table: str, batch_id: int) -> DataFrame:
        path = f"{self.folder}/{table}/batch={batch_id}"
        # A crowded window is cut as well; a task writes one or two windows.
        spread = rows.repartitionByRange("w", *[c for c in ("event_id", "token", "image_digest") if c in rows.columns])
        spread.write.mode("overwrite").partitionBy("w").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def events(self, before: int | None = None, windows: Sequence[int] | None = None) -> DataFrame | None:
        """First copies of all events, with ``batch, w, late``."""
        return self._read("events", before, windows)

    def counts(self, before: int | None = None, windows: Sequence[int] | None = None) -> DataFrame | None:
        """(image_digest, w, family, token, n) after the batches so far."""
        changes = self._read("changes", before, windows)
        if changes is None:
            return None
        return changes.groupBy(*WINDOW, "family", "token").agg(F.sum("n").alias("n")).where("n > 0")

    def scores(self) -> DataFrame:
        """The latest revision of every scored window; ``revision`` is the batch that made it."""
        rows = self._read("scores", None, None)
        names = [c for c in rows.columns if c not in (*WINDOW, "batch")]
        latest = rows.groupBy(*WINDOW).agg(F.max_by(F.struct(*names), "batch").alias("row"), F.max("batch").alias("revision"))
        return latest.select(*WINDOW, "row.*", "revision")

    def add(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, list[int]] | None:
        """Store a batch and the changes it makes; returns its new events and the windows they touch."""
        rows = materialize(batch.withColumn("w", self._window()).where("w IS NOT NULL"))
        # A row per window in the time span of one batch.
        windows = sorted(r["w"] for r in rows.select("w").distinct().collect())
        if not windows:
            return None
        keys = ["is_exec", "event_id"]
        fresh = rows.where("event_id IS NOT NULL").dropDuplicates(keys)
        stored = self.events(batch_id, windows)
        if stored is not None:
            fresh = fresh.join(stored.select(*keys), keys, "left_anti")
        fresh = fresh.unionByName(rows.where("event_id IS NULL"))
        marks = self._read("marks", batch_id, None)
        reached = marks.agg(F.max("reached")).first()[0] if marks is not None else None
        late = F.lit(False) if reached is None else (F.col("w") + 1) * self.width_us + self.anchor_us <= reached
        fresh = self._write(fresh.withColumn("late", late), "events", batch_id)
        self._write(self._changes(fresh, stored), "changes", batch_id)
        mark = rows.agg(F.max(profile.micros(F.col("occurred_at"))).alias("reached"), F.max("w").alias("w"))
        self._write(mark, "marks", batch_id)
        return fresh, windows

    def _changes(self, fresh: DataFrame, stored: DataFrame | None) -> DataFrame:
        execs = fresh.where("is_exec")
        parts = [
            profile.exec_tokens(execs, WINDOW, with_shell=True),
            profile.lifecycle_tokens(fresh.where("NOT is_exec"), WINDOW),
        ]
        sequence = [*WINDOW, "container_id"]
        columns = [*sequence, "event_id", "occurred_at", "process_name", "executable"]
        together = execs.select(*columns)
        if stored is not None:
            # Only containers with new events in a window can have other neighbours there.
            before = stored.where("is_exec").select(*columns).join(execs.select(*sequence).distinct(), sequence, "left_semi")
            before = materialize(before)
            gone = profile.sequence_bigrams(before, WINDOW)
            parts.append(gone.withColumn("n", -F.col("n")))
            together = together.unionByName(before)
        parts.append(profile.sequence_bigrams(together, WINDOW))
        changes = reduce(DataFrame.unionByName, parts)
        return changes.groupBy(*WINDOW, "family", "token").agg(F.sum("n").alias("n")).where("n <> 0")

    def score(
        self, counts: DataFrame, spine: DataFrame, baseline: DataFrame, summary: DataFrame, minimum: int, batch_id: int
    ) -> None:
        """Write the scores of the windows of ``spine`` under a batch number."""
        observed = counts.where(F.col("family") != profile.SHELL_FAMILY)
        numbers = profile.window_numbers(counts.where("family <> 'process_sequence_bigram'"), self.width_us)
        deviations = score.numeric_deviation(profile.fill_windows(numbers, spine), summary)
        families = score.compare_tokens(baseline, observed)
        self._write(score.anomaly_scores(spine, numbers, families, deviations, minimum), "scores", batch_id)

    def score_revised(
        self, fresh: DataFrame, windows: Sequence[int], baseline: DataFrame, summary: DataFrame, minimum: int, batch_id: int
    ) -> None:
        """New revisions of the windows that got events, for images with a baseline."""
        spine = fresh.select(*WINDOW).distinct().join(summary.select("image_digest").distinct(), "image_digest", "left_semi")
        counts = materialize(self.counts(batch_id + 1, windows).join(spine, WINDOW, "left_semi"))
        self.score(counts, materialize(spine), baseline, summary, minimum, batch_id)

    def finish(self, first: int, count: int, baseline: DataFrame, summary: DataFrame, minimum: int) -> None:
        """When the source ends: score the windows in which nothing happened, as revision -1.

        Windows that were open are scored already, each batch revises what it touches.
        """
        spine = profile.window_spine(summary, first, count)
        if sinks.exists(self.spark, f"{self.folder}/scores"):
            spine = spine.join(self._read("scores", None, None).where("batch >= 0").select(*WINDOW).distinct(), WINDOW, "left_anti")
        empty = spine.select(*WINDOW, F.lit("").alias("family"), F.lit("").alias("token"), F.lit(0).cast("bigint").alias("n"))
        self.score(empty.where("false"), materialize(spine), baseline, summary, minimum, -1)


def window_stream(rows: DataFrame, log: WindowLog, checkpoint: str) -> StreamingQuery:
    """Keep the events and counts of a ``feed``; late rows change the windows they belong to."""
    return start(rows, lambda batch, batch_id: log.add(batch, batch_id) and None, checkpoint)


def score_stream(
    rows: DataFrame,
    log: WindowLog,
    baseline: DataFrame,
    summary: DataFrame,
    checkpoint: str,
    minimum: int = config.MIN_PROCESS_EVENTS,
) -> StreamingQuery:
    """Full scores of all windows while the stream runs: all six families, novelty and numbers.

    ``baseline`` and ``summary`` are those of ``Behaviour``.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        added = log.add(batch, batch_id)
        if added is not None:
            log.score_revised(*added, baseline, summary, minimum, batch_id)

    return start(rows, each, checkpoint)
