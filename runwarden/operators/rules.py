"""Built-in detection rules, de-duplication and allowlists.

A run is one scored (image_digest, w) window.  Every rule yields match rows of the
same shape; a detection is their union.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runwarden import config
from runwarden.functions.hashing import sha256_fields
from runwarden.functions.identity import baseline_lookup, parent_path, program_name, program_path
from runwarden.operators.enrich import within_seconds_after
from runwarden.operators.ordering import Ordered
from runwarden.session import materialize

RUN = ["image_digest", "w"]
UNSEEN_COLUMNS = [
    *RUN,
    "event_id",
    "occurred_at",
    "container_id",
    "program",
    "program_path",
    "parent_path",
]
MATCH_TYPES = {
    "image_digest": "string",
    "w": "bigint",
    "rule_id": "string",
    "category": "string",
    "severity_weight": "double",
    "confidence_weight": "double",
    "incident_eligible": "boolean",
    "occurred_at": "timestamp",
    "source_type": "string",
    "source_id": "string",
    "container_id": "string",
    "executable": "string",
    "parent_executable": "string",
    "shell_event_id": "string",
    "tool_event_id": "string",
    "elapsed_seconds": "double",
}


def resolve_identity(execs: DataFrame) -> DataFrame:
    """Add the program behind each execution: ``program``, ``program_path``, ``parent_path``."""
    names = [F.col("executable"), F.col("process_name"), F.col("command_line")]
    parents = [F.col("parent_executable"), F.col("parent_name"), F.col("parent_command_line")]
    return execs.withColumns(
        {
            "program": program_name(*names),
            "program_path": program_path(*names),
            "parent_path": parent_path(*parents),
            "lookup": baseline_lookup(*names),
        }
    )


def unseen_programs(resolved: DataFrame, baseline: DataFrame) -> DataFrame:
    """Distinct (digest, lookup) whose path and name both lack from the baseline."""
    known = baseline.where(F.col("family").isin("executable", "process_name"))
    paths = known.where("family = 'executable'").select("image_digest", F.col("token").alias("_path"))
    names = known.where("family = 'process_name'").select(
        "image_digest", F.lower("token").alias("_name")
    )
    programs = resolved.select(
        "image_digest", F.col("lookup.path").alias("_path"), F.col("lookup.name").alias("_name")
    ).distinct()
    return programs.join(paths, ["image_digest", "_path"], "left_anti").join(
        names.distinct(), ["image_digest", "_name"], "left_anti"
    )


def unseen_execs(resolved: DataFrame, baseline: DataFrame) -> DataFrame:
    """Executions of programs the baseline does not know.

    The baseline test runs once per distinct program, so the event rows only meet the
    few programs that failed it.
    """
    unseen = unseen_programs(resolved, baseline).select(
        F.col("image_digest").alias("_digest"), "_path", "_name"
    )
    on = (
        (F.col("image_digest") == F.col("_digest"))
        & F.col("lookup.path").eqNullSafe(F.col("_path"))
        & F.col("lookup.name").eqNullSafe(F.col("_name"))
    )
    return resolved.join(unseen, on).drop("_digest", "_path", "_name")


def unseen_table(execs: DataFrame, baseline: DataFrame) -> DataFrame:
    """:func:`unseen_execs` written once; few rows that several rules read."""
    return materialize(unseen_execs(resolve_identity(execs), baseline).select(*UNSEEN_COLUMNS))


def seen_flags(resolved: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every execution with ``seen``."""
    unseen = unseen_programs(resolved, baseline).select(
        F.col("image_digest").alias("_digest"), "_path", "_name"
    )
    on = (
        (F.col("image_digest") == F.col("_digest"))
        & F.col("lookup.path").eqNullSafe(F.col("_path"))
        & F.col("lookup.name").eqNullSafe(F.col("_name"))
    )
    joined = resolved.join(unseen.withColumn("_hit", F.lit(True)), on, "left")
    return joined.withColumn("seen", F.col("_hit").isNull()).drop("_digest", "_path", "_name", "_hit")


def _match(rows: DataFrame, rule_id: str, **columns: Column) -> DataFrame:
    _, category, severity, confidence, eligible = next(r for r in config.RULES if r[0] == rule_id)
    values = {
        "rule_id": F.lit(rule_id),
        "category": F.lit(category),
        "severity_weight": F.lit(severity),
        "confidence_weight": F.lit(confidence),
        "incident_eligible": F.lit(eligible),
        **columns,
    }
    return rows.select(
        *[
            values.get(name, F.col(name) if name in RUN else F.lit(None)).cast(kind).alias(name)
            for name, kind in MATCH_TYPES.items()
        ]
    )


def _process_match(rows: DataFrame, rule_id: str, with_parent: bool = True) -> DataFrame:
    columns = {
        "occurred_at": F.col("occurred_at"),
        "source_type": F.lit("process_event"),
        "source_id": F.col("event_id"),
        "container_id": F.col("container_id"),
        "executable": F.col("program_path"),
    }
    if with_parent:
        columns["parent_executable"] = F.col("parent_path")
    return _match(rows, rule_id, **columns)


def high_distance(scores: DataFrame, window_end: Column) -> DataFrame:
    """Rule 1: the window's score reaches the threshold."""
    rows = scores.where(
        (F.col("status") == "scored") & (F.col("total_score") >= config.ANOMALY_THRESHOLD)
    )
    return _match(
        rows,
        "DET-001",
        occurred_at=window_end,
        source_type=F.lit("anomaly_score"),
        source_id=score_id(),
    )


def score_id() -> Column:
    return F.concat_ws(":", "image_digest", F.col("w").cast("string"))


def unseen_shells(unseen: DataFrame) -> DataFrame:
    return unseen.where(F.col("program").isin(config.RULE_SHELLS))


def unseen_tools(unseen: DataFrame) -> DataFrame:
    return unseen.where((F.length("program") > 0) & ~F.col("program").isin(config.RULE_SHELLS))


def new_shell(unseen: DataFrame) -> DataFrame:
    """Rule 2: a shell the baseline does not know."""
    return _process_match(unseen_shells(unseen), "DET-002")


def new_root(resolved: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rule 3: root although the baseline never ran as root."""
    root_digests = baseline.where("family = 'user_uid' AND token = '0'").select("image_digest")
    rows = resolved.where("user_uid = 0").join(root_digests, "image_digest", "left_anti")
    return _process_match(rows, "DET-003", with_parent=False)


def new_tool(unseen: DataFrame) -> DataFrame:
    """Rule 4: all other unknown programs."""
    return _process_match(unseen_tools(unseen), "DET-004")


def surplus_tools(unseen: DataFrame, cap: int = config.UNSEEN_TOOL_CAP) -> DataFrame:
    """How many executions of rule 4 a short list of ``cap`` per run does not show."""
    counts = unseen_tools(unseen).groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        *RUN, F.greatest(F.col("n") - cap, F.lit(0)).alias("additional_unseen_executables")
    )


def shell_then_tool_pairs(unseen: DataFrame, seconds: int = config.CORRELATION_SECONDS) -> DataFrame:
    """Every unknown shell with every unknown tool that followed it in its container."""
    keys = [*RUN, "container_id"]
    named = unseen.where(F.length("container_id") > 0)
    at = F.unix_micros("occurred_at")
    shells = unseen_shells(named).select(
        *keys, F.col("event_id").alias("shell_event_id"), at.alias("shell_us")
    )
    tools = unseen_tools(named).select(
        *keys, F.col("event_id").alias("tool_event_id"), "occurred_at", at.alias("tool_us")
    )
    pairs = within_seconds_after(shells, tools, keys, seconds, "shell_us", "tool_us")
    elapsed = F.round((F.col("tool_us") - F.col("shell_us")) / 1e6, 6)
    return pairs.withColumn("elapsed_seconds", elapsed)


def shell_then_tool(unseen: DataFrame, seconds: int = config.CORRELATION_SECONDS) -> DataFrame:
    """Rule 5."""
    pairs = shell_then_tool_pairs(unseen, seconds)
    return _match(
        pairs,
        "DET-005",
        occurred_at=F.col("occurred_at"),
        source_type=F.lit("derived_correlation"),
        source_id=F.concat_ws(":", "shell_event_id", "tool_event_id"),
        container_id=F.col("container_id"),
        shell_event_id=F.col("shell_event_id"),
        tool_event_id=F.col("tool_event_id"),
        elapsed_seconds=F.col("elapsed_seconds"),
    )


def shell_then_tool_counts(unseen: DataFrame, seconds: int = config.CORRELATION_SECONDS) -> DataFrame:
    """(run, container_id, tool_event_id, shells): how many shells each tool pairs with.

    For totals the pairs themselves are not needed: in time order, the shells so far
    less the shells that have run out is the number a tool pairs with.  The work grows
    with the events and not with the pairs.
    """
    keys = [*RUN, "container_id"]
    named = unseen.where(F.length("container_id") > 0)
    at, ident = F.unix_micros("occurred_at"), F.col("event_id")

    def marks(rows: DataFrame, when: Column, kind: int, value: int) -> DataFrame:
        return rows.select(
            *keys,
            when.alias("at"),
            F.lit(kind).alias("kind"),
            ident.alias("id"),
            F.lit(value).cast("bigint").alias("change"),
        )

    shells, tools = unseen_shells(named), unseen_tools(named)
    # At the same instant a shell counts for a tool, and one that runs out still does.
    line = marks(shells, at, 0, 1).unionByName(marks(tools, at, 1, 0))
    line = line.unionByName(marks(shells, at + seconds * 1_000_000, 2, -1))
    open_ = Ordered(line, keys, ["at", "kind", "id"]).running_sum({"shells": F.col("change")}).rows
    return open_.where("kind = 1 AND shells > 0").select(*keys, F.col("id").alias("tool_event_id"), "shells")


def _lifecycle_match(rows: DataFrame, rule_id: str) -> DataFrame:
    return _match(
        rows,
        rule_id,
        occurred_at=F.col("occurred_at"),
        source_type=F.lit("runtime_event"),
        source_id=F.col("event_id"),
        container_id=F.col("container_id"),
    )


def exec_activity(lifecycle: DataFrame) -> DataFrame:
    """Rule 6: someone ran a command in a container from outside."""
    condition = (F.col("event_type") == "container") & F.col("action").isin(config.EXEC_ACTIONS)
    return _lifecycle_match(lifecycle.where(condition), "DET-006")


def privileged_start(lifecycle: DataFrame) -> DataFrame:
    """Rule 7: a privileged container was created or started."""
    condition = (
        (F.col("event_type") == "container")
        & F.col("action").isin(config.START_ACTIONS)
        & F.coalesce("privileged", F.lit(False))
    )
    return _lifecycle_match(lifecycle.where(condition), "DET-007")


def built_in_matches(
    execs: DataFrame,
    lifecycle: DataFrame,
    baseline: DataFrame,
    unseen: DataFrame,
    scores: DataFrame,
    window_end: Column,
    correlation_seconds: int = config.CORRELATION_SECONDS,
) -> DataFrame:
    """All seven rules over all scored runs; ``unseen`` is :func:`unseen_table`."""
    resolved = resolve_identity(execs)
    matches = high_distance(scores, window_end)
    for part in (
        new_shell(unseen),
        new_root(resolved, baseline),
        new_tool(unseen),
        shell_then_tool(unseen, correlation_seconds),
        exec_activity(lifecycle),
        privileged_start(lifecycle),
    ):
        matches = matches.unionByName(part)
    return only_scored(matches, scores)


def only_scored(rows: DataFrame, scores: DataFrame) -> DataFrame:
    return rows.join(scores.where("status = 'scored'").select(*RUN), RUN, "left_semi")


def deduplicate(matches: DataFrame) -> DataFrame:
    """One match per (run, rule, source); of repeated ones the last by time stays."""
    keys = [*RUN, "rule_id", "source_type", "source_id"]
    others = [c for c in matches.columns if c not in keys]
    kept = matches.groupBy(*keys).agg(
        F.max(F.struct("occurred_at", *[c for c in others if c != "occurred_at"])).alias("_m")
    )
    return kept.select(*keys, "_m.*").select(*matches.columns)


# --- allowlists --------------------------------------------------------------------------


def active_allowlists(allowlists: DataFrame, as_of: Column) -> DataFrame:
    """Entries that are switched on and not expired at ``as_of``."""
    live = F.col("expires_at").isNull() | (F.col("expires_at") > as_of)
    return allowlists.where(F.col("active") & live)


def _first_entries(allowlists: DataFrame, filled: Sequence[str]) -> DataFrame:
    """Smallest id of the entries that fill exactly these fields, per digest, rule and their values."""
    shape = F.lit(True)
    for name in ("executable", "parent_executable"):
        shape = shape & (F.col(name).isNotNull() if name in filled else F.col(name).isNull())
    keys = [F.col(n).alias(f"_e_{n}") for n in ("image_digest", "rule_id", *filled)]
    return allowlists.where(shape).groupBy(*keys).agg(F.min("allowlist_id").alias("_by_" + "_".join(("any", *filled))))


def apply_allowlists(matches: DataFrame, allowlists: DataFrame) -> DataFrame:
    """Add ``suppressed_by``, null for active matches.

    The first entry by id whose filled fields all agree suppresses a match.  A rule 5
    match has no fields of its own: it is suppressed when its shell or its tool was.

    An entry fills none, one or both of two fields.  For each of these four patterns the
    entries are reduced to the first id per digest, rule and filled values, and matches meet
    them by equality, so a match has at most four partners whatever the number of entries.
    """
    direct, found = matches, []
    for filled in ((), ("executable",), ("parent_executable",), ("executable", "parent_executable")):
        entries = _first_entries(allowlists, filled)
        on = F.col("rule_id") != "DET-005"
        for name in ("image_digest", "rule_id", *filled):
            on = on & (F.col(name) == F.col(f"_e_{name}"))
        direct = direct.join(entries, on, "left").drop(*[c for c in entries.columns if c.startswith("_e_")])
        found.append(entries.columns[-1])
    direct = direct.withColumn("suppressed_by", F.least(*found)).drop(*found)

    sources = (
        direct.where(F.col("rule_id").isin("DET-002", "DET-004") & F.col("suppressed_by").isNotNull())
        .groupBy(*RUN, F.col("source_id").alias("_id"))
        .agg(F.min("suppressed_by").alias("_by"))
    )
    derived = direct.where("rule_id = 'DET-005'")
    shells = sources.select(*RUN, F.col("_id").alias("shell_event_id"), F.col("_by").alias("_shell"))
    tools = sources.select(*RUN, F.col("_id").alias("tool_event_id"), F.col("_by").alias("_tool"))
    derived = (
        derived.join(shells, [*RUN, "shell_event_id"], "left")
        .join(tools, [*RUN, "tool_event_id"], "left")
        .withColumn("suppressed_by", F.coalesce("_shell", "_tool"))
        .drop("_shell", "_tool")
    )
    return direct.where("rule_id <> 'DET-005'").unionByName(derived)


def unique_active(allowlists: DataFrame) -> DataFrame:
    """Violations of "one active entry per matcher"."""
    matcher = ["image_digest", "rule_id", "executable", "parent_executable"]
    order = Window.partitionBy(*matcher).orderBy("allowlist_id")
    return allowlists.where("active").withColumn("copy", F.row_number().over(order)).where("copy > 1")


# --- identities of rule sets and runs ----------------------------------------------------


def _digest(document: object) -> str:
    text = json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def ruleset_hash() -> str:
    return _digest({"rules": config.RULES, "names": config.RULE_NAMES})


def custom_ruleset_hash(custom: list[dict]) -> str:
    """Order of the rules does not matter."""
    return _digest(sorted(custom, key=lambda rule: rule["slug"]))


def matcher_hash() -> Column:
    """Identity of what an allowlist entry matches."""
    names = ["image_digest", "rule_id", "executable", "parent_executable"]
    return sha256_fields({n: F.col(n) for n in names})


def run_key(score_key: Column, allowlist_hash: str, custom_hash: str) -> Column:
    """Identity of a detection run; the same inputs give the same key."""
    return sha256_fields(
        {
            "score_id": score_key,
            "ruleset_hash": F.lit(ruleset_hash()),
            "allowlist_set_hash": F.lit(allowlist_hash),
            "custom_ruleset_hash": F.lit(custom_hash),
        }
    )
