"""From matches to detection runs, incidents, timelines and recommendations.

Containers and evidence of an incident are rows of their own tables: one incident
may touch any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden import config
from runwarden.functions.hashing import sha256_fields
from runwarden.operators.enrich import ancestor_chain
from runwarden.operators.ordering import Ordered
from runwarden.operators.rules import RUN, score_id
from runwarden.session import materialize


def level(value: Column, limits: Sequence[tuple[float, str]], top: str) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, name in limits:
        out = out.when(value < limit, F.lit(name))
    return out.otherwise(F.lit(top))


def severity_level(value: Column) -> Column:
    return level(value, config.SEVERITY_LEVELS, config.TOP_SEVERITY)


def confidence_level(value: Column) -> Column:
    return level(value, config.CONFIDENCE_LEVELS, config.TOP_CONFIDENCE)


def noisy_or(confidence: Column) -> Column:
    """Probability-style union of independent confidences."""
    return 1 - F.product(1 - confidence)


def _unit(value: Column) -> Column:
    return F.round(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)), 12)


def summarize_matches(matches: DataFrame) -> DataFrame:
    """Per run: match counts, strongest severity, combined confidence, evidence sources.

    ``matches`` is the output of the allowlist step, with ``suppressed_by``.
    """
    active = F.col("suppressed_by").isNull()
    eligible = active & F.col("incident_eligible")
    return matches.groupBy(*RUN).agg(
        F.count_if(active).alias("matches"),
        F.count_if(eligible).alias("eligible_matches"),
        F.count_if(~active).alias("suppressed_matches"),
        F.max(F.when(eligible, F.col("severity_weight"))).alias("max_severity"),
        noisy_or(F.when(active, F.col("confidence_weight"))).alias("combined_confidence"),
        F.count_distinct(F.when(active, F.col("source_type"))).alias("source_types"),
    )


def detection_runs(scores: DataFrame, matches: DataFrame) -> DataFrame:
    """Status, severity and confidence of every run, scored or not."""
    joined = scores.select(*RUN, "status", "total_score", "exec_count", "lifecycle_count").join(
        summarize_matches(matches), RUN, "left"
    )
    counts = ["matches", "eligible_matches", "suppressed_matches", "source_types"]
    joined = joined.fillna(0, counts).fillna(0.0, ["combined_confidence"])
    scored = F.col("status") == "scored"
    evidence = 0.75 * F.least(F.col("exec_count") / 5, F.lit(1.0)) + 0.25 * (
        F.col("lifecycle_count") > 0
    ).cast("double")
    confidence = _unit(
        0.5 * F.col("combined_confidence")
        + 0.25 * F.least(F.col("source_types") / 3, F.lit(1.0))
        + 0.25 * evidence
    )
    bonus = F.least(F.lit(0.12), 0.03 * (F.col("eligible_matches") - 1))
    severity = F.when(
        F.col("eligible_matches") > 0,
        _unit(0.65 * F.col("max_severity") + 0.35 * F.col("total_score") + bonus),
    ).otherwise(_unit(0.25 * F.col("total_score")))
    status = (
        F.when(~scored, "insufficient_data")
        .when(F.col("eligible_matches") > 0, "incident_created")
        .when(F.col("matches") > 0, "findings_only")
        .otherwise("no_findings")
    )
    severity, confidence = F.when(scored, severity), F.when(scored, confidence).otherwise(0.0)
    return joined.select(
        *RUN,
        status.alias("run_status"),
        "total_score",
        "exec_count",
        "lifecycle_count",
        *counts,
        severity.alias("severity_score"),
        F.when(scored, severity_level(severity)).otherwise("unknown").alias("severity_level"),
        confidence.alias("confidence_score"),
        confidence_level(confidence).alias("confidence_level"),
    )


def incidents(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """One incident per run with eligible matches, led by its strongest finding."""
    active = matches.where("suppressed_by IS NULL")
    lead = F.when(
        F.col("incident_eligible"), F.struct("severity_weight", "confidence_weight", "rule_id")
    )
    facts = active.groupBy(*RUN).agg(
        F.max(lead).getField("rule_id").alias("leading_rule"),
        F.min("occurred_at").alias("first_seen_at"),
        F.max("occurred_at").alias("last_seen_at"),
        F.bool_or(F.col("rule_id").isin(config.STOP_RULES)).alias("has_stop_rule"),
    )
    opened = runs.where("run_status = 'incident_created'")
    return opened.join(facts, RUN).withColumn("incident_id", incident_id()).withColumn(
        "status", F.lit("open")
    )


def incident_id() -> Column:
    return F.concat(F.lit("incident:"), score_id())


def incident_containers(matches: DataFrame) -> DataFrame:
    """Distinct containers of each run's active matches, as rows."""
    active = matches.where("suppressed_by IS NULL AND length(container_id) > 0")
    return active.select(*RUN, "container_id").distinct()


def timeline(opened: DataFrame, matches: DataFrame, window_end: Column) -> DataFrame:
    """Score row and active matches of each incident, numbered by (time, type, id).

    Evidence columns of the matches, where they have been added, come along.
    """
    active = matches.where("suppressed_by IS NULL").join(opened.select(*RUN), RUN, "left_semi")
    columns = ["occurred_at", "source_type", "source_id", "rule_id"]
    more = [c for c in (*EVIDENCE.values(), "process_chain", "elapsed_seconds") if c in matches.columns]
    evidence = active.select(*RUN, *columns, F.col("category").alias("evidence_type"), *more)
    score = opened.select(
        *RUN,
        window_end.alias("occurred_at"),
        F.lit("anomaly_score").alias("source_type"),
        score_id().alias("source_id"),
        F.lit(None).cast("string").alias("rule_id"),
        F.lit("behavioural_distance").alias("evidence_type"),
    )
    rows = evidence.unionByName(score, allowMissingColumns=True).withColumn("_rule", F.coalesce("rule_id", F.lit("")))
    order = ["occurred_at", "source_type", "source_id", "_rule"]
    return Ordered(rows, RUN, order).number("sequence_no").rows.drop("_rule")


def _applied_steps() -> int:
    """Most changes that can be applied to one incident: the longest way through the steps."""

    def longest(status: str, seen: tuple[str, ...]) -> int:
        if status in seen:
            raise ValueError(f"a status may not come back: {status}")
        return max((1 + longest(s, (*seen, status)) for s in config.STATUS_STEPS.get(status, ())), default=0)

    return longest("open", ())


def fold_status(changes: DataFrame) -> DataFrame:
    """Each change with the status before it and whether it was allowed.

    changes: incident_id, changed_at, change_id, new_status; of one incident they count in the
    order of the other three columns.  Returns ``incident_id, status`` (the last one), ``change_id,
    before, result``.

    A status never comes back, so only a few changes of an incident can be applied, however many
    it has.  Each round finds the first allowed change after the one applied before, as a
    minimum that is combined before the shuffle; the status before any change then
    follows from its place among them.  No incident is sorted or gathered.  Rows that repeat a
    change are marked alike.
    """
    place = F.struct("changed_at", "change_id", "new_status")
    rows = changes.select("incident_id", "change_id", "new_status", place.alias("_place"))
    applied = rows.select("incident_id").distinct().withColumn("_s0", F.lit("open"))
    rounds = _applied_steps()

    def may_follow(status: str, wanted: Column) -> Column:
        allowed = F.lit(False)
        for before, following in config.STATUS_STEPS.items():
            allowed = allowed | ((F.col(status) == before) & wanted.isin(list(following)))
        return allowed

    same = F.col("incident_id").eqNullSafe(F.col("_incident"))
    for turn in range(1, rounds + 1):
        joined = rows.join(applied.withColumnRenamed("incident_id", "_incident"), same)
        later = may_follow(f"_s{turn - 1}", F.col("new_status"))
        if turn > 1:
            later = later & (F.col("_place") > F.col(f"_p{turn - 1}"))
        first = joined.where(later).groupBy(F.col("incident_id").alias("_incident")).agg(F.min("_place").alias(f"_p{turn}"))
        applied = applied.join(first, same, "left").drop("_incident")
        applied = materialize(applied.withColumn(f"_s{turn}", F.col(f"_p{turn}.new_status")))
    final = F.coalesce(*[f"_s{turn}" for turn in range(rounds, -1, -1)])
    before = F.col("_s0")
    for turn in range(1, rounds + 1):
        before = F.when(F.col("_place") > F.col(f"_p{turn}"), F.col(f"_s{turn}")).otherwise(before)
    hit = F.lit(False)
    for turn in range(1, rounds + 1):
        hit = hit | F.coalesce(F.col("_place") == F.col(f"_p{turn}"), F.lit(False))
    joined = rows.join(applied.withColumnRenamed("incident_id", "_incident"), same)
    marked = joined.select("incident_id", final.alias("status"), "change_id", before.alias("before"), "new_status", hit.alias("_hit"))
    result = F.when(F.col("new_status") == F.col("before"), "unchanged").when(F.col("_hit"), "applied").otherwise("rejected")
    return marked.select("incident_id", "status", "change_id", "before", result.alias("result"))


def recommend(opened: DataFrame, containers: DataFrame) -> DataFrame:
    """Allowed and recommended action per incident and container (or none)."""
    joined = opened.where(F.col("status").isin("open", "acknowledged")).join(containers, RUN, "left")
    target = F.col("container_id").isNotNull()
    severity, confidence = F.col("severity_score"), F.col("confidence_score")
    pause = (
        target
        & (severity >= config.PAUSE_MIN_SEVERITY)
        & (confidence >= config.PAUSE_MIN_CONFIDENCE)
    )
    stop = (
        target
        & (severity >= config.STOP_MIN_SEVERITY)
        & (confidence >= config.STOP_MIN_CONFIDENCE)
        & F.col("has_stop_rule")
    )
    allowed = F.array_compact(
        F.array(
            F.lit("observe_only"),
            F.when(pause, F.lit("pause_container")),
            F.when(stop, F.lit("stop_container")),
        )
    )
    key = sha256_fields(
        {"incident_id": F.col("incident_id"), "target_container_id": F.col("container_id")}
    )
    return joined.select(
        "incident_id",
        "container_id",
        allowed.alias("allowed_actions"),
        F.element_at(allowed, -1).alias("recommended_action"),
        key.alias("recommendation_key"),
    )


def alert_worthy(opened: DataFrame, minimum: str) -> DataFrame:
    """Open incidents at or above a severity level."""
    wanted = config.SEVERITY_ORDER[config.SEVERITY_ORDER.index(minimum) :]
    return opened.where((F.col("status") == "open") & F.col("severity_level").isin(wanted))


def new_alerts(opened: DataFrame, notified: DataFrame, minimum: str) -> DataFrame:
    """Open incidents at or above a severity level that nobody was told about."""
    return alert_worthy(opened, minimum).join(notified.select("incident_id").distinct(), "incident_id", "left_anti")


#: Fields of an execution that stand behind a match, by the names they have there.
EVIDENCE = {
    "process_name": "process_name",
    "executable": "raw_executable",
    "parent_name": "parent_name",
    "parent_executable": "raw_parent_executable",
    "user_uid": "user_uid",
    "command_line": "command_line",
    "parent_event_id": "parent_event_id",
}


def subject_event() -> Column:
    """Event that a match is about: its own, or the tool of a shell-then-tool pair."""
    own = F.when(F.col("source_type") == "process_event", F.col("source_id"))
    return F.coalesce("tool_event_id", own)


def match_evidence(matches: DataFrame, execs: DataFrame) -> DataFrame:
    """Matches with what their event looked like, as reported, and the chain of processes above it.

    ``execs`` has ``parent_event_id``.  Adds the columns of ``EVIDENCE`` and ``process_chain``: event
    ids from the event itself to its root, inside the run.  Only events that matches are
    about meet the matches; chains are built in runs with matches.  Matches about
    scores and lifecycle events have nulls.
    """
    asked = matches.withColumn("_subject", subject_event())
    wanted = materialize(asked.where("_subject IS NOT NULL").select(*RUN, F.col("_subject").alias("event_id")).distinct())
    inside = execs.join(wanted.select(*RUN).distinct(), RUN, "left_semi")
    chains = ancestor_chain(inside, RUN, node=F.struct(F.col("event_id").alias("event_id")))
    found = inside.join(wanted, [*RUN, "event_id"], "left_semi").join(chains, [*RUN, "event_id"], "left")
    above = F.coalesce(F.col("ancestors.event_id"), F.array().cast("array<string>"))
    fields = [F.col(name).alias(alias) for name, alias in EVIDENCE.items()]
    found = found.select(
        *RUN, F.col("event_id").alias("_subject"), *fields, F.concat(F.array("event_id"), above).alias("process_chain")
    )
    return asked.join(found, [*RUN, "_subject"], "left").drop("_subject")


def evidence_bundle(
    opened: DataFrame, scores: DataFrame, lines: DataFrame, rule_texts: DataFrame
) -> DataFrame:
    """Rows of an export: incident, score, timeline position and rule text.

    One row per timeline entry; the distinct sorted rule ids are numbered per incident.
    """
    head = opened.select(*RUN, "incident_id", "severity_level", "confidence_level")
    rules = lines.where("rule_id IS NOT NULL").select(*RUN, "rule_id").distinct()
    described = rules.join(rule_texts, "rule_id", "left")
    body = lines.join(described, [*RUN, "rule_id"], "left")
    totals = scores.select(*RUN, "total_score", "score_band")
    return head.join(totals, RUN).join(body, RUN)
