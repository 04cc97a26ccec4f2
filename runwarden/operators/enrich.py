"""Identity and parent enrichment, latest-state folds, ancestor chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runwarden import config
from runwarden.functions.identity import parent_path, program_path
from runwarden.operators.ordering import Ordered
from runwarden.session import materialize

PREFIX = 12


# --- container identity ------------------------------------------------------------------


def resolve_reported_ids(reported: DataFrame, containers: DataFrame) -> DataFrame:
    """Status and identity of each distinct (reported id, reported host).

    A reported id matches a container when it equals or prefixes the full id, and
    the hosts agree if one was reported.  One match resolves, several are ambiguous.

    reported     reported_container_id, reported_docker_host_id (duplicates allowed)
    containers   container_id, docker_host_id and identity columns

    Ids of twelve or more characters are joined by equality of that prefix.
    Shorter ones are joined by equality too: every container offers its prefixes of
    the lengths that occur, which are at most eleven.
    """
    ids = reported.select("reported_container_id", "reported_docker_host_id").distinct()
    usable = ids.where(
        (F.length("reported_container_id") > 0) & (F.col("reported_container_id") != "host")
    )
    keyed = usable.withColumn(
        "_length", F.least(F.length("reported_container_id"), F.lit(PREFIX))
    ).withColumn("_prefix", F.substring("reported_container_id", 1, PREFIX))
    lengths = keyed.select("_length").distinct()
    every_length = F.sequence(F.lit(1), F.least(F.length("container_id"), F.lit(PREFIX)))
    offered = containers.withColumn("_length", F.explode(every_length))
    offered = offered.join(lengths, "_length", "left_semi").withColumn(
        "_prefix", F.expr("substring(container_id, 1, _length)")
    )
    identity = F.struct(*[F.col(c) for c in containers.columns]).alias("_identity")
    offered = offered.select("_length", "_prefix", identity)
    matches = keyed.join(offered, ["_length", "_prefix"]).where(
        F.col("_identity.container_id").startswith(F.col("reported_container_id"))
        & (
            (F.coalesce("reported_docker_host_id", F.lit("")) == "")
            | (F.col("reported_docker_host_id") == F.col("_identity.docker_host_id"))
        )
    )
    keys = ["reported_container_id", "reported_docker_host_id"]
    counted = matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), F.min("_identity").alias("_identity")
    )
    single = F.col("matches") == 1
    return counted.select(
        *keys,
        F.when(single, "resolved").otherwise("ambiguous").alias("correlation_status"),
        F.when(single, F.col("_identity")).alias("identity"),
    )


def resolve_container(events: DataFrame, containers: DataFrame) -> DataFrame:
    """Add ``correlation_status`` and ``identity`` to events.

    The lookup runs on the distinct reported ids; only its result meets the events.
    """
    lookup = resolve_reported_ids(events, containers)
    right = lookup.select(
        F.col("reported_container_id").alias("_rid"),
        F.col("reported_docker_host_id").alias("_rhost"),
        "correlation_status",
        "identity",
    )
    on = (F.col("reported_container_id") == F.col("_rid")) & F.col(
        "reported_docker_host_id"
    ).eqNullSafe(F.col("_rhost"))
    joined = events.join(right, on, "left").drop("_rid", "_rhost")
    return joined.withColumn(
        "correlation_status", F.coalesce("correlation_status", F.lit("unresolved"))
    )


def apply_identity(events: DataFrame) -> DataFrame:
    """Identity columns from the resolved container, else the reported values.

    Image id and digest are never taken from the report.
    """
    reported = {
        "docker_host_id": "reported_docker_host_id",
        "container_id": "reported_container_id",
        "container_name": "reported_container_name",
        "image_ref": "reported_image_ref",
    }
    out = events
    for name, fallback in reported.items():
        out = out.withColumn(name, F.coalesce(F.col(f"identity.{name}"), F.col(fallback)))
    for name in ("image_id", "image_digest"):
        out = out.withColumn(name, F.col(f"identity.{name}"))
    return out.drop("identity")


# --- parent correlation ------------------------------------------------------------------


def scope_tier(kind: str, *parts: Column) -> Column:
    """Name of a scope in which a parent is looked for."""
    return F.concat_ws("|", F.lit(kind), *parts)


def correlate_parent(
    execs: DataFrame, lookback_seconds: int = config.PARENT_LOOKBACK_SECONDS
) -> DataFrame:
    """(event_id, parent_event_id): the latest execution of the parent pid.

    A parent has ``process_pid`` equal to the probe's ``process_ppid``, is not later,
    and lies within the look-back.  Host and container must agree where the probe
    knows them; a probe that knows neither must agree on the sensor.  Ties on time
    go to the largest event id.

    No join over time, see :func:`parent_answers`.
    """
    return parent_answers(execs, lookback_seconds).select("event_id", "parent_event_id")


def parent_answers(execs: DataFrame, lookback_seconds: int) -> DataFrame:
    """(event_id, time_nano, parent_event_id) of every probe of :func:`correlate_parent`.

    Candidates and probes are put in one set per (scope, pid) and
    the latest candidate is carried forward in time order.  The sets are cut into buckets as
    long as the look-back, and a candidate stands in its own and the next one, where any probe
    that may take it is; so one shuffle does, and a busy pid is spread over its buckets.
    """
    has_host = F.length(F.coalesce("docker_host_id", F.lit(""))) > 0
    has_container = F.length(F.coalesce("container_id", F.lit(""))) > 0
    host, container = F.col("docker_host_id"), F.col("container_id")
    both = scope_tier("hc", host, container)
    width = lookback_seconds * 1_000_000_000
    bucket = F.floor(F.col("time_nano") / F.lit(width)).cast("bigint") if width else F.col("time_nano")
    asked_scope = (
        F.when(has_host & has_container, both)
        .when(has_host, scope_tier("h", host))
        .when(has_container, scope_tier("c", container))
        .otherwise(scope_tier("s", F.col("sensor_instance_id")))
    )

    def entry(condition: Column, scope: Column, pid: str, kind: int, place: Column) -> Column:
        values = F.struct(
            scope.alias("scope"), F.col(pid).cast("bigint").alias("pid"), F.lit(kind).alias("kind"), place.alias("bucket")
        )
        return F.when(condition, values)

    is_probe, known = F.col("process_ppid") > 0, F.col("process_pid").isNotNull()
    full = known & has_host & has_container
    columns = ["event_id", "time_nano"]
    entries = F.array(
        entry(is_probe, asked_scope, "process_ppid", 1, bucket),
        entry(full, both, "process_pid", 0, bucket),
        entry(full, both, "process_pid", 0, bucket + 1),
    )
    rows = execs.select(*columns, F.inline(F.array_compact(entries)))
    # Probes without host or container are rare; only keys they ask for are offered.
    asked = execs.where(is_probe & ~(has_host & has_container)).select(
        asked_scope.alias("scope"), F.col("process_ppid").cast("bigint").alias("pid")
    )
    partial = F.array(
        *[
            entry(known & condition, scope, "process_pid", 0, place)
            for condition, scope in (
                (has_host, scope_tier("h", host)),
                (has_container, scope_tier("c", container)),
                (F.length("sensor_instance_id") > 0, scope_tier("s", F.col("sensor_instance_id"))),
            )
            for place in (bucket, bucket + 1)
        ]
    )
    other = execs.select(*columns, F.inline(F.array_compact(partial)))
    rows = rows.unionByName(other.join(asked.distinct(), ["scope", "pid"], "left_semi").select(rows.columns))

    line = Window.partitionBy("scope", "pid", "bucket").orderBy("time_nano", "kind", "event_id")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    candidate = F.when(F.col("kind") == 0, F.struct(F.col("time_nano").alias("t"), F.col("event_id").alias("id")))
    # Every candidate also carries the one before it, for probes that are their own candidate.
    rows = rows.withColumn("candidate", candidate)
    rows = rows.withColumn("previous", F.last("candidate", ignorenulls=True).over(before))
    offer = F.when(F.col("kind") == 0, F.struct("candidate", "previous"))
    found = rows.withColumn("found", F.last(offer, ignorenulls=True).over(upto)).where("kind = 1")
    latest, earlier = F.col("found.candidate"), F.col("found.previous")
    parent = F.when(latest.getField("id") == F.col("event_id"), earlier).otherwise(latest)
    # Times are compared as stored, in microseconds: a parent at the edge still counts.
    whole = lambda nanos: nanos - F.pmod(nanos, F.lit(1000))
    recent = whole(parent.getField("t")) >= whole(F.col("time_nano")) - F.lit(width)
    return found.select("event_id", "time_nano", F.when(recent, parent.getField("id")).alias("parent_event_id"))


def with_parent(execs: DataFrame, lookback_seconds: int = config.PARENT_LOOKBACK_SECONDS) -> DataFrame:
    links = correlate_parent(execs, lookback_seconds).where("parent_event_id IS NOT NULL")
    return execs.join(links, "event_id", "left")


# --- ancestors ---------------------------------------------------------------------------


def _node() -> Column:
    return F.struct(
        F.col("event_id").alias("event_id"),
        program_path(F.col("executable"), F.col("process_name"), F.col("command_line")).alias("executable"),
        parent_path(
            F.col("parent_executable"), F.col("parent_name"), F.col("parent_command_line")
        ).alias("parent_executable"),
        F.col("occurred_at").alias("occurred_at"),
    )


def ancestor_chain(
    execs: DataFrame,
    keys: Sequence[str] = (),
    limit: int | None = None,
    node: Column | None = None,
) -> DataFrame:
    """(keys, event_id, ancestors) of the events that have one, from the parent upwards.

    A parent counts only when it is inside the same ``keys`` group.  The walk stops at
    a repeated node, and after ``limit`` nodes where a limit is given.

    Chains are doubled instead of walked: chains that have reached their full length
    so far are extended by the chain of their last node, so a chain of n hops takes
    log2(n) joins.  Each round is written to the checkpoint folder, because it is read
    twice by the next one, and the rounds end when no chain grows any more.
    """
    keys = list(keys)
    entry = _node() if node is None else node
    nodes = execs.select(*keys, F.col("event_id").alias("_up"), entry.alias("_node"))
    start = execs.select(*keys, "event_id", F.col("parent_event_id").alias("_up"))
    chains = start.where(F.col("_up").isNotNull()).join(nodes, [*keys, "_up"])
    chains = materialize(chains.select(*keys, "event_id", F.array("_node").alias("ancestors")))
    length = 1
    while limit is None or length < limit:
        # A chain that repeats a node holds its whole loop and grows no more.
        ids = F.transform("ancestors", lambda one: one["event_id"])
        grows = (F.size("ancestors") == length) & (F.size(F.array_distinct(ids)) == length)
        full = chains.where(grows)
        if full.isEmpty():
            break
        tails = chains.select(*keys, F.col("event_id").alias("_up"), F.col("ancestors").alias("_more"))
        longer = full.withColumn("_up", F.element_at("ancestors", -1).getField("event_id"))
        longer = longer.join(tails, [*keys, "_up"], "left").select(
            *keys,
            "event_id",
            F.concat("ancestors", F.coalesce("_more", F.slice("ancestors", 1, 0))).alias("ancestors"),
        )
        chains = materialize(chains.where(~grows).unionByName(longer))
        length *= 2
    # In a walk along single parents everything after the first repeat repeats, so the
    # distinct prefix is where the walk stops.
    walked = F.array_distinct("ancestors")
    if limit is not None:
        walked = F.slice(walked, 1, limit)
    return chains.select(*keys, "event_id", walked.alias("ancestors"))


def with_ancestors(
    execs: DataFrame, keys: Sequence[str] = (), node: Column | None = None
) -> DataFrame:
    """Events with their ``ancestors``, empty where there are none."""
    chains = ancestor_chain(execs, keys, node=node)
    empty = F.array().cast(chains.schema["ancestors"].dataType)
    joined = execs.join(chains, [*keys, "event_id"], "left")
    return joined.withColumn("ancestors", F.coalesce("ancestors", empty))


#: Conditions that one column of :func:`ancestor_bits` holds.
BITS = 62


def ancestor_bits(execs: DataFrame, keys: Sequence[str], tests: Sequence[Column]) -> DataFrame:
    """(keys, event_id, bits0, bits1, …): which ``tests`` some ancestor of an event meets.

    Test i is bit ``i % 62`` of column ``bits{i // 62}``; events without an ancestor have no row.
    As in :func:`ancestor_chain` a parent counts only inside the same ``keys`` group.

    Pointer jumping over rows of fixed size: a row holds the bits met by the nearest 2**k
    ancestors and points at the last of them.  A round ORs in the bits of the row it points
    at and takes over its pointer, so chains of n hops take log2(n) rounds and no row grows.
    In a loop of parents the rounds end when they have covered all events.
    """
    keys = list(keys)
    names = [f"bits{i}" for i in range(-(-len(tests) // BITS))]
    own = []
    for column, name in enumerate(names):
        value = F.lit(0).cast("bigint")
        for bit, test in enumerate(tests[column * BITS : (column + 1) * BITS]):
            value = value.bitwiseOR(F.when(test, F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        own.append(value.alias(name))
    nodes = execs.select(*keys, F.col("event_id").alias("_id"), *own)
    start = execs.where("parent_event_id IS NOT NULL").select(*keys, "event_id", F.col("parent_event_id").alias("_id"))
    # A repeated event id would multiply rows in every round.
    first = [F.first(c).alias(c) for c in names]
    state = materialize(
        start.dropDuplicates([*keys, "event_id"])
        .join(nodes.groupBy(*keys, "_id").agg(*first), [*keys, "_id"])
        .select(*keys, "event_id", F.col("_id").alias("_up"), *names)
    )
    covered, count = 1, state.count()
    while covered <= count and not state.where("_up IS NOT NULL").isEmpty():
        jumps = state.select(
            *keys, F.col("event_id").alias("_up"), F.col("_up").alias("_beyond"), F.lit(True).alias("_hit"),
            *[F.col(n).alias(f"_{n}") for n in names],
        )
        # Rows that have reached their root only move to the next table.
        joined = state.join(jumps, [*keys, "_up"], "left")
        merged = [F.col(n).bitwiseOR(F.coalesce(f"_{n}", F.lit(0).cast("bigint"))).alias(n) for n in names]
        state = materialize(joined.select(*keys, "event_id", F.col("_beyond").alias("_up"), *merged))
        covered *= 2
    return state.drop("_up")


def process_chain(execs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ordered nodes from the event itself to its root."""
    chain = F.concat(F.array(_node()), F.col("ancestors")).alias("process_chain")
    return with_ancestors(execs, keys).select(*keys, "event_id", chain)


# --- interval join -----------------------------------------------------------------------


def within_seconds_after(
    left: DataFrame, right: DataFrame, keys: Sequence[str], seconds: int, left_at: str, right_at: str
) -> DataFrame:
    """Pairs with the same keys where the right time is in [left, left + seconds].

    Times are microseconds.  Both sides are bucketed by the interval and the left
    side is offered to its own and the next bucket, so rows meet only if they are
    close.  The join is on (keys, bucket), which adaptive execution can split further
    when one of them is hot.
    """
    width = seconds * 1_000_000
    bucket = F.floor(F.col(left_at) / width).cast("bigint")
    offered = left.dropna(subset=list(keys)).withColumn(
        "_bucket", F.explode(F.array(bucket, bucket + 1))
    )
    probe = right.dropna(subset=list(keys)).withColumn(
        "_bucket", F.floor(F.col(right_at) / width).cast("bigint")
    )
    near = (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + width)
    return offered.join(probe, [*keys, "_bucket"]).where(near).drop("_bucket")


# --- latest-state folds ------------------------------------------------------------------


def _identity_state(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], status: str) -> DataFrame:
    """Mergeable state per key: each column with the time it was seen.

    Each column keeps its newest non-null value by observation time, the earlier of
    occurrence and receipt; ties on time go to the largest value.  A failed inspection
    counts as a status only when there is no other.
    """
    seen = F.least("occurred_at", "received_at")

    def stamped(value: Column) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct(seen.alias("o"), value.alias("v"))))

    failed = F.col(status) == "inspection_failed"
    return rows.groupBy(*keys).agg(
        *[stamped(F.col(c)).alias(c) for c in columns],
        stamped(F.when(~failed, F.col(status))).alias(status),
        stamped(F.when(failed, F.col(status))).alias("failed_status"),
        F.min(seen).alias("first_seen_at"),
        F.max(seen).alias("last_seen_at"),
    )


def _merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in states.columns if c not in (*keys, "first_seen_at")]
    return states.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in values], F.min("first_seen_at").alias("first_seen_at")
    ).select(*states.columns)


def _identity_view(state: DataFrame, keys: Sequence[str], columns: Sequence[str], status: str) -> DataFrame:
    return state.select(
        *keys,
        *[F.col(c).getField("v").alias(c) for c in columns],
        F.coalesce(F.col(status).getField("v"), F.col("failed_status").getField("v")).alias(status),
        "first_seen_at",
        "last_seen_at",
    )


IMAGE_KEYS, IMAGE_COLUMNS = ["docker_host_id", "image_id"], ["image_ref", "image_digest"]
CONTAINER_KEYS = ["docker_host_id", "container_id"]
CONTAINER_COLUMNS = ["container_name", "image_id", "image_ref", "image_digest"]
STATUS = "image_digest_status"


def image_identities(events: DataFrame) -> DataFrame:
    """Latest state of every image, whatever order its events arrive in."""
    rows = events.where(F.length("image_id") > 0)
    state = _identity_state(rows, IMAGE_KEYS, IMAGE_COLUMNS, STATUS)
    return _identity_view(state, IMAGE_KEYS, IMAGE_COLUMNS, STATUS)


def container_identities(events: DataFrame, snapshot: str | None = None) -> DataFrame:
    """Latest state of every container; an empty snapshot keeps the older one."""
    columns = [*CONTAINER_COLUMNS, *([snapshot] if snapshot else [])]
    rows = events.where(F.length("container_id") > 0)
    state = _identity_state(rows, CONTAINER_KEYS, columns, STATUS)
    return _identity_view(state, CONTAINER_KEYS, columns, STATUS)


def identity_state(events: DataFrame) -> DataFrame:
    """Container state of one batch of events, to be merged with earlier states."""
    rows = events.where(F.length("container_id") > 0)
    return _identity_state(rows, CONTAINER_KEYS, CONTAINER_COLUMNS, STATUS)


def merge_identity_state(states: DataFrame) -> DataFrame:
    return _merge_states(states, CONTAINER_KEYS)


def identity_view(state: DataFrame) -> DataFrame:
    """The container table that a merged state stands for."""
    return _identity_view(state, CONTAINER_KEYS, CONTAINER_COLUMNS, STATUS)


def fold_heartbeats(beats: DataFrame, now: Column) -> DataFrame:
    """Status that arrived last and newest observation, clipped to now, per instance."""
    seen = F.least("observed_at", now)
    return beats.groupBy("service_name", "instance_id").agg(
        F.max_by("status", "arrival").alias("status"),
        F.min_by(seen, "arrival").alias("first_seen_at"),
        F.max(seen).alias("last_seen_at"),
    )


# --- profile versions --------------------------------------------------------------------


def number_versions(builds: DataFrame) -> DataFrame:
    """Version per digest in order of creation; a repeated hash is no new version."""
    first = builds.groupBy("image_digest", "model_hash").agg(
        F.min(F.struct("created_at", "profile_id")).alias("_first")
    )
    rows = first.select(
        F.col("_first.profile_id").alias("profile_id"),
        "image_digest",
        "model_hash",
        F.col("_first.created_at").alias("created_at"),
    )
    return Ordered(rows, ["image_digest"], ["created_at", "profile_id"]).number("profile_version").rows


def active_profiles(profiles: DataFrame) -> DataFrame:
    """Status after all activations: the last passing one is active, earlier ones retired.

    profiles: image_digest, profile_id, activated_at (null when never), passed.  Drafts are not
    ordered, so they move nowhere.
    """
    valid = F.coalesce(F.col("activated_at").isNotNull() & F.col("passed"), F.lit(False))
    activated = Ordered(profiles.where(valid), ["image_digest"], ["activated_at", "profile_id"])
    status = F.when(F.col("retired_at").isNull(), "active").otherwise("retired")
    drafts = profiles.where(~valid)
    kind = dict(profiles.dtypes)["activated_at"]
    drafts = drafts.withColumns({"retired_at": F.lit(None).cast(kind), "status": F.lit("draft")})
    return activated.lead("activated_at", "retired_at").with_column("status", status).rows.unionByName(drafts)


def profile_for_window(windows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile to score each window with.

    windows    window_id, image_digest, start_us, end_us, profile_id (null = active one)
    profiles   profile_id, image_digest, status, passed, training_start_us, training_end_us
    A window that overlaps its training interval gets none.
    """
    columns = ["image_digest", "training_start_us", "training_end_us"]
    named = profiles.where("passed AND status <> 'draft'").select("profile_id", *columns)
    active = profiles.where("status = 'active'").select("profile_id", *columns)
    # A named profile is looked up by its id and the active one is unique per digest, so no
    # window meets more than one profile.
    explicit = windows.where("profile_id IS NOT NULL").join(named, ["profile_id", "image_digest"])
    default = windows.where("profile_id IS NULL").drop("profile_id").join(active, "image_digest")
    both = explicit.unionByName(default)
    overlap = (F.col("start_us") < F.col("training_end_us")) & (
        F.col("end_us") > F.col("training_start_us")
    )
    return both.where(~overlap).select("window_id", "image_digest", "profile_id")


# --- predicates, pages, top-k ------------------------------------------------------------


def filter_events(
    df: DataFrame,
    equals: dict | None = None,
    prefixes: dict | None = None,
    minimums: dict | None = None,
    before: dict | None = None,
    allowed: dict | None = None,
) -> DataFrame:
    """The list filters as one conjunction; parameters that are None are left out.

    ``allowed`` maps a column to its vocabulary and rejects other values of ``equals``.
    """
    condition = F.lit(True)
    for name, value in (equals or {}).items():
        if value is None:
            continue
        if allowed and name in allowed and value not in allowed[name]:
            raise ValueError(f"{name} must be one of {sorted(allowed[name])}")
        condition = condition & (F.col(name) == value)
    for name, value in (prefixes or {}).items():
        if value is not None:
            condition = condition & F.col(name).startswith(value)
    for name, value in (minimums or {}).items():
        if value is not None:
            condition = condition & (F.col(name) >= value)
    for name, value in (before or {}).items():
        if value is not None:
            condition = condition & (F.col(name) < value)
    return df.where(condition)


def keyset_page(df: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """Next page, newest first.  The cursor is (time_nano, event_id), so ties are not lost."""
    if after is not None:
        at, last = after
        df = df.where(
            (F.col("time_nano") < at) | ((F.col("time_nano") == at) & (F.col("event_id") > last))
        )
    return df.orderBy(F.desc("time_nano"), "event_id").limit(size)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)
