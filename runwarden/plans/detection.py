"""Scores, matches, runs and incidents of all windows in one job."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden import config
from runwarden.operators import custom_rules, enrich, incidents, rules
from runwarden.plans.behaviour import Behaviour
from runwarden.session import materialize


class Detection:
    """Lazy plans over a :class:`Behaviour`.

    Scores and matches are small next to the events and feed several results each,
    so both are written once to the checkpoint folder.
    """

    def __init__(
        self,
        behaviour: Behaviour,
        allowlists: DataFrame,
        custom: list[dict] | None = None,
        correlation_seconds: int = config.CORRELATION_SECONDS,
        lookback_seconds: int = config.PARENT_LOOKBACK_SECONDS,
        min_process_events: int = config.MIN_PROCESS_EVENTS,
    ):
        self.behaviour = behaviour
        self.allowlists = allowlists
        self.custom = custom or []
        self.correlation_seconds = correlation_seconds
        self.lookback_seconds = lookback_seconds
        self.min_process_events = min_process_events
        self.execs = behaviour.execs.where("w >= 0")
        self.lifecycle = behaviour.lifecycle.where("w >= 0")

    @property
    def window_end(self) -> F.Column:
        i = self.behaviour.interval
        return F.timestamp_micros(F.lit(i.cut_us) + (F.col("w") + 1) * F.lit(i.window_us))

    @cached_property
    def scores(self) -> DataFrame:
        return materialize(self.behaviour.scores(self.min_process_events))

    @cached_property
    def unseen(self) -> DataFrame:
        """Executions of programs the baseline does not know; few, and read by three rules."""
        return rules.unseen_table(self.execs, self.behaviour.baseline)

    @cached_property
    def linked(self) -> DataFrame:
        """Scored executions with their parents."""
        return materialize(enrich.with_parent(self.execs, self.lookback_seconds))

    @cached_property
    def custom_results(self) -> tuple[DataFrame, DataFrame]:
        return custom_rules.custom_matches(self.custom, self.linked, self.lifecycle)

    @cached_property
    def raw_matches(self) -> DataFrame:
        found = rules.built_in_matches(
            self.execs,
            self.lifecycle,
            self.behaviour.baseline,
            self.unseen,
            self.scores,
            self.window_end,
            self.correlation_seconds,
        )
        if self.custom:
            extra = rules.only_scored(self.custom_results[0], self.scores)
            found = found.unionByName(extra)
        # Allowlists, runs and timelines read the matches several times.
        return materialize(rules.deduplicate(found))

    @cached_property
    def matches(self) -> DataFrame:
        """All matches with ``suppressed_by``."""
        return materialize(rules.apply_allowlists(self.raw_matches, self.allowlists))

    @cached_property
    def runs(self) -> DataFrame:
        return incidents.detection_runs(self.scores, self.matches)

    @cached_property
    def incidents(self) -> DataFrame:
        return materialize(incidents.incidents(self.runs, self.matches))

    @cached_property
    def containers(self) -> DataFrame:
        return incidents.incident_containers(self.matches)

    @cached_property
    def evidence(self) -> DataFrame:
        """Matches of incidents with command line, user, raw names and process chain."""
        opened = self.matches.join(self.incidents.select(*rules.RUN), rules.RUN, "left_semi")
        return materialize(incidents.match_evidence(opened, self.linked))

    @cached_property
    def evidence_timeline(self) -> DataFrame:
        return incidents.timeline(self.incidents, self.evidence, self.window_end)

    @cached_property
    def timeline(self) -> DataFrame:
        return incidents.timeline(self.incidents, self.matches, self.window_end)
