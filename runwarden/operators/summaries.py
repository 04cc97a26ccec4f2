"""Counts over whole tables, each in one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden.operators.profile import union_all


def lifecycle_summary(events: DataFrame) -> DataFrame:
    known = F.col("container_id").isNotNull()
    resolved = F.col("image_digest_status") == "resolved"
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("container_id").alias("distinct_containers"),
        F.count_if(resolved).alias("resolved_digest_events"),
        F.count_if(known & ~resolved).alias("unresolved_digest_events"),
    )


def count_by(events: DataFrame, column: str) -> DataFrame:
    return events.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def exec_summary(events: DataFrame) -> DataFrame:
    status = F.col("correlation_status")
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("container_id").alias("distinct_containers"),
        *[F.count_if(status == s).alias(f"{s}_events") for s in ("resolved", "unresolved", "ambiguous")],
        F.count("parent_event_id").alias("linked_parent_events"),
    )


def top_names(events: DataFrame, column: str = "process_name", limit: int = 50) -> DataFrame:
    return count_by(events, column).orderBy(F.desc("n"), column).limit(limit)


def system_counts(tables: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """(name, n) rows: the size of every table and of its named subsets, one scan each."""
    parts = []
    for name, (frame, subsets) in tables.items():
        conditions = {name: F.lit(True), **subsets}
        counts = frame.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions.values())])
        pairs = [
            F.struct(F.lit(label).alias("name"), F.col(f"c{i}").alias("n"))
            for i, label in enumerate(conditions)
        ]
        parts.append(counts.select(F.inline(F.array(*pairs))))
    return union_all(parts)


def feed_freshness(known: DataFrame, events: DataFrame, keys: list[str], as_of: Column, threshold_seconds: int) -> DataFrame:
    """State of every known feed at ``as_of``, with the age of its newest event.

    known: keys, ``reachable``.  ``live`` is a feed with an event within the threshold, ``stale`` one
    whose newest event is older, ``none`` one without any event; of a feed that cannot be asked
    nothing is known, so its state is ``unknown`` and its age null.
    """
    newest = events.groupBy(*keys).agg(F.max("occurred_at").alias("newest"))
    age = F.when(F.col("reachable"), (F.unix_micros(as_of) - F.unix_micros("newest")) / 1e6)
    state = (
        F.when(~F.coalesce("reachable", F.lit(False)), "unknown")
        .when(F.col("newest").isNull(), "none")
        .when(age <= threshold_seconds, "live")
        .otherwise("stale")
    )
    return known.join(newest, keys, "left").select(*keys, age.alias("age_seconds"), state.alias("state"))


def service_freshness(heartbeats: DataFrame, as_of: Column) -> DataFrame:
    """A service is fresh while its last beat is at most three of its intervals old."""
    age = (F.unix_micros(as_of) - F.unix_micros("last_seen_at")) / 1e6
    return heartbeats.select(
        "service_name",
        "instance_id",
        age.alias("age_seconds"),
        (age <= 3 * F.col("interval_seconds")).alias("fresh"),
    )
