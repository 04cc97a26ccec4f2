"""Parent links of a stream with state by day and expiry in event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from runwarden import config
from runwarden.operators import enrich
from runwarden.operators.enrich import scope_tier
from runwarden.operators.ordering import TIME_STEP
from runwarden.sources import sinks
from runwarden.streaming.pipelines import start

_ENTRY = "time_nano bigint, kind int, event_id string, parent string, answered boolean"
LINK = "event_id string, parent_event_id string"


def link_rows(execs: DataFrame) -> DataFrame:
    """Each execution as a candidate under all scopes it can be asked for in, and as a probe under one.

    Scopes are those of ``enrich.correlate_parent``: host and container, one of them, or the sensor.
    """
    host, container = F.col("docker_host_id"), F.col("container_id")
    has_host, has_container = F.length(F.coalesce(host, F.lit(""))) > 0, F.length(F.coalesce(container, F.lit(""))) > 0
    both, sensor = scope_tier("hc", host, container), scope_tier("s", F.col("sensor_instance_id"))
    asked = F.when(has_host & has_container, both).when(has_host, scope_tier("h", host))
    asked = asked.when(has_container, scope_tier("c", container)).otherwise(sensor)

    def entry(condition: Column, scope: Column, pid: str, kind: int) -> Column:
        values = F.struct(scope.alias("scope"), F.col(pid).cast("bigint").alias("pid"), F.lit(kind).alias("kind"))
        return F.when(condition, values)

    known = F.col("process_pid").isNotNull()
    entries = F.array_compact(
        F.array(
            entry(known & has_host & has_container, both, "process_pid", 0),
            entry(known & has_host, scope_tier("h", host), "process_pid", 0),
            entry(known & has_container, scope_tier("c", container), "process_pid", 0),
            entry(known & (F.length("sensor_instance_id") > 0), sensor, "process_pid", 0),
            entry(F.col("process_ppid") > 0, asked, "process_ppid", 1),
        )
    )
    return execs.select("event_id", "time_nano", "occurred_at", F.inline(entries))


class ParentLinks(StatefulProcessor):
    """Candidates and probes of one (scope, pid) in time order, for ``transformWithState`` over :func:`link_rows`.

    For short look-backs: all that a key can still need is one list.  :func:`parent_stream` cuts keys by time.

    A probe is answered when it comes and again when a candidate arrives that changes the answer.
    An entry goes when no row that is still accepted can need it: a probe behind the watermark, a
    candidate behind it by more than the look-back.
    """

    def __init__(self, lookback_seconds: int):
        self.lookback_us = lookback_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", _ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(e) for e in self.entries.get()] if self.entries.exists() else []
        known = {(e[0], e[1], e[2]) for e in held}
        for row in rows:
            place = (row.time_nano, row.kind, row.event_id)
            if place not in known:  # a repeated event adds nothing
                known.add(place)
                held.append((*place, None, False))
        held.sort(key=lambda e: (e[0], e[1], e[2] or ""))
        latest, before, kept = None, None, []
        for at, kind, event_id, parent, answered in held:
            if kind == 0:
                latest, before = (at, event_id), latest
                kept.append((at, kind, event_id, None, False))
                continue
            found = before if latest is not None and latest[1] == event_id else latest
            # Times are compared as stored, in microseconds.
            near = found is not None and found[0] // 1000 >= at // 1000 - self.lookback_us
            now = found[1] if near else None
            if now != parent or not answered:
                yield Row(event_id=event_id, parent_event_id=now)
            kept.append((at, kind, event_id, now, True))
        self._keep(kept, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.entries.exists():
            self._keep([tuple(e) for e in self.entries.get()], timerValues)
        return iter(())

    def close(self) -> None:
        pass

    def _keep(self, entries: list[tuple], timer_values) -> None:
        watermark_us = timer_values.getCurrentWatermarkInMs() * 1000
        ends = [e[0] // 1000 + (self.lookback_us if e[1] == 0 else 0) for e in entries]
        left = [e for e, end in zip(entries, ends, strict=True) if end >= watermark_us]
        if not left:
            self.entries.clear()
            return
        self.entries.put(left)
        # One timer for each key, at its last end.
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(ends) // 1000 + 1)


_DAY_NANO = TIME_STEP * 1000
_ROW = (
    "event_id string, docker_host_id string, container_id string, sensor_instance_id string, "
    "process_pid bigint, process_ppid bigint, time_nano bigint, us bigint, day bigint, batch bigint"
)
#: Day of rows without a time, which meet nothing.
_NO_DAY = -(2**31)


def _seen_rows(execs: DataFrame) -> DataFrame:
    columns = ["event_id", "docker_host_id", "container_id", "sensor_instance_id"]
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("process_pid", "process_ppid", "time_nano")]
    day = F.coalesce(F.floor(F.col("time_nano") / _DAY_NANO).cast("bigint"), F.lit(_NO_DAY).cast("bigint"))
    return execs.select(*columns, *numbers, F.unix_micros("occurred_at").alias("us"), day.alias("day"))


def _day_of(path: str) -> int:
    return int(path.rstrip("/").rsplit("day=", 1)[1].split("/")[0])


def _lateness_us(spark: SparkSession, lateness: str) -> int:
    zero = F.timestamp_micros(F.lit(0))
    return spark.range(1).select(F.unix_micros(zero + F.expr(f"INTERVAL '{lateness}'"))).first()[0]


def parent_stream(
    execs: DataFrame,
    links: str,
    checkpoint: str,
    lookback_seconds: int = config.PARENT_LOOKBACK_SECONDS,
    lateness: str = "1 hour",
) -> StreamingQuery:
    """Parent links of a stream, written to ``links`` batch by batch; read them with :func:`latest_links`.

    ``lateness`` is how far behind the newest event of earlier batches one may arrive and still be
    linked and link others.  A link that a later arrival changes is written again.

    The state is the rows and their answers, as files by day beside the checkpoint of the query.  A batch
    reads only the days its rows can meet and answers their probes with ``enrich.parent_answers``, whose sets
    are cut by the look-back, so neither a busy pid nor a long lateness gathers in one task.  Days that no
    accepted row can meet any more are removed.  A batch that is repeated writes the same folders again.
    """
    spark, state = execs.sparkSession, f"{checkpoint.rstrip('/')}/rows"
    span = -(-lookback_seconds * 1_000_000 // TIME_STEP)
    late_us = _lateness_us(spark, lateness)

    def each(batch: DataFrame, batch_id: int) -> None:
        mine, marks = f"batch={batch_id}", f"{state}/marks"
        spark = batch.sparkSession
        reached = None
        if earlier := [p for p in sinks.matching(spark, f"{marks}/batch=*") if int(p.rsplit("=", 1)[1]) < batch_id]:
            reached = spark.read.schema("us bigint").parquet(*earlier).agg(F.max("us")).first()[0]
        accepted = batch
        if reached is not None:
            first_us = reached - late_us
            accepted = batch.where(F.coalesce(F.unix_micros("occurred_at") > first_us, F.lit(True)))
            gone = (first_us - lookback_seconds * 1_000_000) // TIME_STEP
            for path in sinks.matching(spark, f"{state}/*/day=*"):
                if _NO_DAY < _day_of(path) < gone:
                    sinks.remove(spark, path)
        # Dynamic: a repeated batch replaces its own folders and no other.
        writer = _seen_rows(accepted).withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{state}/seen")
        reader = spark.read.schema(_ROW).option("basePath", f"{state}/seen")
        written = sinks.matching(spark, f"{state}/seen/day=*/{mine}")
        if not written:
            spark.createDataFrame([], LINK).write.mode("overwrite").parquet(f"{links}/{mine}")
            return
        new = reader.parquet(*written)
        new.agg(F.max("us").alias("us")).write.mode("overwrite").parquet(f"{marks}/{mine}")
        touched = {_day_of(p) for p in written}
        # A row can change answers up to a look-back later, and they need rows of a look-back before.
        asked = {d + i for d in touched if d != _NO_DAY for i in range(span + 1)} | (touched & {_NO_DAY})
        needed = asked | {d - i for d in asked if d != _NO_DAY for i in range(1, span + 1)}
        near = [p for p in sinks.matching(spark, f"{state}/seen/day=*") if _day_of(p) in needed]
        known = reader.parquet(*near).where(F.col("batch") <= batch_id).drop("day", "batch", "us").distinct()
        day = F.coalesce(F.floor(F.col("time_nano") / _DAY_NANO).cast("bigint"), F.lit(_NO_DAY).cast("bigint"))
        answers = enrich.parent_answers(known, lookback_seconds).select("event_id", "parent_event_id", day.alias("day"))
        answers = answers.where(F.col("day").isin(sorted(asked))).distinct()
        reader = spark.read.schema(f"{LINK}, day bigint, batch bigint").option("basePath", f"{state}/told")
        told = [p for p in sinks.matching(spark, f"{state}/told/day=*") if _day_of(p) in asked]
        if told:
            before = reader.parquet(*told).where(F.col("batch") < batch_id)
            latest = F.max_by(F.struct("parent_event_id"), "batch").alias("l")
            before = before.groupBy("event_id", "day").agg(latest).select("event_id", "day", "l.parent_event_id")
            equal = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in before.columns]
            answers = answers.alias("a").join(before.alias("b"), equal, "left_anti")
        writer = answers.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{state}/told")
        changed = sinks.matching(spark, f"{state}/told/day=*/{mine}")
        fresh = reader.parquet(*changed).select("event_id", "parent_event_id") if changed else spark.createDataFrame([], LINK)
        fresh.write.mode("overwrite").parquet(f"{links}/{mine}")

    return start(execs, each, checkpoint)


def latest_links(written: DataFrame) -> DataFrame:
    """(event_id, parent_event_id) after the last batch."""
    batch = F.col("batch").cast("bigint")
    return written.groupBy("event_id").agg(F.max_by(F.struct("parent_event_id"), batch).alias("l")).select(
        "event_id", "l.parent_event_id"
    )
