"""Raw sensor and lifecycle lines to event rows; rejected lines to dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden import config, schemas
from runwarden.functions.frames import computed_once
from runwarden.functions.hashing import sha256_fields, sorted_map
from runwarden.functions.text import (
    action_category,
    action_detail,
    clip,
    clip_utf8,
    image_reference,
    non_negative_int,
    primary_digest,
    redact,
    tag_list,
)
from runwarden.operators.ordering import Ordered


def _filled(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(F.length(v) > 0, v) for v in values])


# --- times -------------------------------------------------------------------------------


def iso_nanos(text: Column) -> Column:
    """Nanoseconds since the epoch of an ISO-8601 time with up to nine fraction digits."""
    base = F.regexp_extract(text, config.ISO_TIME_PATTERN, 1)
    fraction = F.regexp_extract(text, config.ISO_TIME_PATTERN, 2)
    zone = F.regexp_extract(text, config.ISO_TIME_PATTERN, 3)
    offset = F.when(zone == "Z", "+00:00").otherwise(
        F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    )
    at = F.try_to_timestamp(F.concat(base, offset), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    nanos = F.rpad(F.substring(fraction, 1, 9), 9, "0").cast("bigint")
    return F.when(F.length(base) > 0, F.unix_seconds(at) * 1_000_000_000 + nanos)


def event_nanos(raw_time: Column, iso_time: Column) -> Column:
    return F.coalesce(non_negative_int(raw_time), iso_nanos(clip(iso_time)))


def time_of_nanos() -> Column:
    return F.timestamp_micros(F.expr("time_nano div 1000"))


# --- executions --------------------------------------------------------------------------


def parse_sensor_lines(lines: DataFrame) -> DataFrame:
    """Add the parsed line ``d`` and whether it is a JSON object.  lines: raw."""
    valid = F.try_parse_json("raw").isNotNull() & F.ltrim("raw").startswith("{")
    return computed_once(lines, is_object=valid, d=F.from_json("raw", schemas.SENSOR_LINE))


def classify_sensor_lines(lines: DataFrame, expected_rule: str) -> DataFrame:
    """Add ``outcome`` (ok, ignored, malformed, error) and ``error`` to parsed lines."""
    fields = lambda name: F.col(f"d.output_fields")[name]
    parsed = parse_sensor_lines(lines)
    known = (clip(F.col("d.rule")) == expected_rule) & (
        F.coalesce(clip(F.col("d.source")), F.lit("syscall")) == "syscall"
    )
    raw_fields = F.get_json_object("raw", "$.output_fields")
    odd_fields = raw_fields.isNotNull() & ~raw_fields.startswith("{") & ~raw_fields.isin("", "[]", "0", "false")
    parsed = computed_once(
        parsed,
        known=F.coalesce(known, F.lit(False)),
        time_nano=event_nanos(fields("evt.rawtime"), F.col("d.time")),
        pid=non_negative_int(fields("proc.pid")),
        on_host=F.coalesce(clip(fields("container.id")) == "host", F.lit(False)),
        odd_fields=F.coalesce(odd_fields, F.lit(False)),
    )
    error = (
        F.when(~F.col("is_object"), "JSONDecodeError: line is not a JSON object")
        .when(~F.col("known"), None)
        .when(F.col("odd_fields"), "ValueError: output_fields must be a JSON object")
        .when(F.col("time_nano").isNull(), "ValueError: event has no readable time")
        .when(F.col("pid").isNull(), "ValueError: event has no process id")
    )
    outcome = (
        F.when(~F.col("is_object"), "malformed")
        .when(~F.col("known"), "ignored")
        .when(error.isNotNull(), "error")
        .when(F.col("on_host"), "ignored")
        .otherwise("ok")
    )
    return parsed.withColumns({"outcome": outcome, "error": error})


def exec_events(classified: DataFrame, sensor_id: str, host_id: str | None) -> DataFrame:
    """Normalised execution rows of the accepted lines."""
    ok = classified.where("outcome = 'ok'")
    field = lambda name: F.col("d.output_fields")[name]
    event_type = F.coalesce(clip(field("evt.type")), F.lit("execve"))
    vpid = F.coalesce(field("proc.vpid"), field("thread.vpid"))
    columns = {
        "sensor_instance_id": F.lit(sensor_id),
        "sensor_hostname": clip(F.col("d.hostname")),
        "rule_name": clip(F.col("d.rule")),
        "priority": F.coalesce(clip(F.col("d.priority")), F.lit("Notice")),
        "occurred_at": time_of_nanos(),
        "time_nano": F.col("time_nano"),
        "event_number": non_negative_int(field("evt.num")),
        "event_type": event_type,
        "reported_docker_host_id": F.lit(host_id).cast("string"),
        "reported_container_id": clip(field("container.id")),
        "reported_container_name": clip(field("container.name")),
        "reported_image_ref": image_reference(
            clip(field("container.image.repository")), clip(field("container.image.tag"))
        ),
        "process_pid": non_negative_int(field("proc.pid")),
        "process_ppid": non_negative_int(field("proc.ppid")),
        "process_vpid": non_negative_int(vpid),
        "process_name": clip(field("proc.name")),
        "executable": clip(field("proc.exepath")),
        "command_line": clip(field("proc.cmdline")),
        "working_directory": clip(field("proc.cwd")),
        "tty": non_negative_int(field("proc.tty")),
        "parent_name": clip(field("proc.pname")),
        "parent_executable": clip(field("proc.pexepath")),
        "parent_command_line": clip(field("proc.pcmdline")),
        "user_uid": non_negative_int(field("user.uid")),
        "user_name": clip(field("user.name")),
        "group_gid": non_negative_int(field("group.gid")),
        "group_name": clip(field("group.name")),
        "tags": tag_list(F.col("d.tags")),
        "output": clip(F.col("d.output")),
        "output_fields": F.col("d.output_fields"),
        "raw_event": F.parse_json("raw"),
    }
    rows = computed_once(ok.select("raw", "d", "time_nano"), row=F.struct(*[c.alias(n) for n, c in columns.items()]))
    return rows.select("row.*").withColumn("event_id", exec_event_id()).select("event_id", *columns)


def exec_event_id() -> Column:
    """Identity of an execution; ints and strings only, so the text is canonical."""
    return sha256_fields(
        {
            "sensor_instance_id": F.col("sensor_instance_id"),
            "time_nano": F.col("time_nano"),
            "event_number": F.col("event_number"),
            "event_type": F.col("event_type"),
            "container_id": F.col("reported_container_id"),
            "process_pid": F.col("process_pid"),
            "process_ppid": F.col("process_ppid"),
            "command_line": F.col("command_line"),
        }
    )


def normalize_exec_lines(
    lines: DataFrame, sensor_id: str, expected_rule: str, host_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of raw sensor lines."""
    classified = classify_sensor_lines(lines, expected_rule)
    rejected = classified.where("outcome IN ('malformed', 'error')")
    return exec_events(classified, sensor_id, host_id), dead_letters(rejected)


def ingest_counters(classified: DataFrame, events: DataFrame) -> DataFrame:
    """One row of counters; a duplicate is a repeated event id."""
    outcome = F.col("outcome")
    lines = classified.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(outcome == "ok").alias("accepted"),
        F.count_if(outcome == "ignored").alias("ignored"),
        F.count_if(outcome.isin("malformed", "error")).alias("malformed"),
    )
    unique = events.agg(F.count_distinct("event_id").alias("enqueued"))
    both = lines.withColumn("_k", F.lit(1)).join(unique.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("duplicates", F.col("accepted") - F.col("enqueued")).drop("accepted")


# --- dead letters ------------------------------------------------------------------------


def dead_letters(rejected: DataFrame, excerpt_bytes: int = config.EXCERPT_BYTES) -> DataFrame:
    """Redacted, bounded record of each rejected line.  rejected: raw, error (class: message)."""
    has_message = F.contains("error", F.lit(":"))
    error_class = F.substring_index("error", ":", 1)
    message = F.trim(F.regexp_extract("error", r"(?s)^[^:]*:(.*)$", 1))
    extra = [c for c in rejected.columns if c in ("recorded_at", "id", "source_file")]
    return rejected.select(
        *extra,
        F.sha2("raw", 256).alias("raw_sha256"),
        F.octet_length("raw").cast("bigint").alias("raw_byte_length"),
        clip_utf8(redact(F.col("raw")), excerpt_bytes).alias("excerpt"),
        error_class.alias("error_class"),
        F.when(has_message, redact(message)).otherwise("").alias("error_message"),
    )


_COPIES_AT_ONCE = 100_000


def number_letters(letters: DataFrame, source: str = "source_file") -> DataFrame:
    """A ``letter_id`` per rejected line, the same however often its file is read.

    Equal lines of one file cannot be told apart, so they are counted and numbered 1, 2,
    … in place of an order that would need them in one task.  The numbers are laid out in
    two steps, so no row holds one element per copy.
    """
    keys = [source, "raw_sha256"]
    others = [c for c in letters.columns if c not in keys]
    kinds = letters.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    step = F.lit(_COPIES_AT_ONCE).cast("bigint")
    kinds = kinds.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"), step)))
    last = F.least(F.col("_n"), F.col("_from") + step - 1)
    rows = kinds.withColumn("copy", F.explode(F.sequence("_from", last)))
    text = F.concat_ws("|", F.coalesce(source, F.lit("")), "raw_sha256", F.col("copy").cast("string"))
    return rows.select(F.sha2(text, 256).alias("letter_id"), *letters.columns, "copy")


def retain_dead_letters(
    rows: DataFrame, cutoff: Column, max_rows: int, max_bytes: int
) -> DataFrame:
    """Rows that survive age, then count, then total excerpt size; newest ones first.

    rows: id (number), recorded_at, excerpt.  The running totals over the whole table
    are computed in time-ordered chunks when the table is large.
    """
    fresh = rows.where(F.col("recorded_at") >= cutoff).withColumns(
        {
            "_newest": -F.unix_micros("recorded_at"),
            "_id": -F.col("id"),
            "_bytes": F.octet_length("excerpt").cast("bigint"),
        }
    )
    line = Ordered(fresh, [], ["_newest", "_id"])
    totals = line.running_sum({"_rank": F.lit(1).cast("bigint"), "_total": F.coalesce("_bytes", F.lit(0))})
    kept = totals.rows.where((F.col("_rank") <= max_rows) & (F.col("_total") <= max_bytes))
    return kept.select(*rows.columns)


def dead_letter_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    inserted = before.agg(F.count(F.lit(1)).alias("inserted")).withColumn("_k", F.lit(1))
    size = F.coalesce(F.sum(F.octet_length("excerpt").cast("bigint")), F.lit(0))
    retained = after.agg(F.count(F.lit(1)).alias("retained_count"), size.alias("retained_bytes"))
    both = inserted.join(retained.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("evicted", F.col("inserted") - F.col("retained_count"))


# --- lifecycle ---------------------------------------------------------------------------


def lifecycle_events(lines: DataFrame, host_id: str) -> DataFrame:
    """Normalised lifecycle rows.

    lines: raw, and optionally inspection (JSON text of the container at that time).
    Keys may come in either case; the first filled one counts.
    """
    v = F.col("v")

    def text(*paths: str) -> Column:
        return _filled(*[F.try_variant_get(v, f"$.{p}", "string") for p in paths])

    def number(*paths: str) -> Column:
        found = [F.try_variant_get(v, f"$.{p}", "bigint") for p in paths]
        return F.coalesce(*[F.when(f != 0, f) for f in found], F.lit(0).cast("bigint"))

    attributes = F.coalesce(
        *[
            F.when(F.size(m) > 0, m)
            for m in (
                F.try_variant_get(v, f"$.{p}", "map<string,string>")
                for p in ("Actor.Attributes", "Actor.attributes", "actor.Attributes", "actor.attributes")
            )
        ],
        F.create_map().cast("map<string,string>"),
    )
    nanos = number("timeNano", "TimeNano")
    inspected = "inspection" in lines.columns
    documents = {"v": F.try_parse_json("raw")}
    if inspected:
        documents["inspected"] = F.from_json("inspection", schemas.INSPECTION)
    parsed = computed_once(lines, **documents).where("v IS NOT NULL")
    columns = [
        F.lower(F.coalesce(text("Type", "type"), F.lit("unknown"))).alias("event_type"),
        F.coalesce(text("Action", "action", "status"), F.lit("unknown")).alias("raw_action"),
        text("scope", "Scope").alias("scope"),
        F.coalesce(text("Actor.ID", "Actor.Id", "actor.ID", "actor.Id", "id"), F.lit("unknown")).alias("actor_id"),
        F.when(nanos > 0, nanos).otherwise(number("time", "Time") * 1_000_000_000).alias("time_nano"),
        attributes.alias("attributes"),
        *([reduce_snapshot("inspected").alias("snapshot")] if inspected else []),
    ]
    head = computed_once(parsed.select("v", *(["inspected"] if inspected else [])), h=F.struct(*columns)).select("h.*")
    if not inspected:
        head = head.withColumn("snapshot", F.lit(None))
    rows = head.withColumn("action", action_category(F.col("raw_action")))
    a = lambda name: F.col("attributes")[name]
    container = (
        F.when(F.col("event_type") == "container", _filled(F.col("actor_id")))
        .when(F.col("event_type") == "network", _filled(a("container"), a("containerID"), a("container_id")))
    )
    rows = rows.withColumn("container_id", container)
    known = F.col("container_id").isNotNull()

    def snap(path: str) -> Column:
        value = F.col(f"snapshot.{path}") if inspected else F.lit(None).cast("string")
        return F.when(known, value)

    detail = F.when(F.col("action").isin("exec_create", "exec_start"), action_detail(F.col("raw_action")))
    configured = F.array_join(snap("config.command"), " ") if inspected else F.lit(None).cast("string")
    columns = {
        "docker_host_id": F.lit(host_id),
        "event_type": F.col("event_type"),
        "action": F.col("action"),
        "scope": F.col("scope"),
        "actor_id": F.col("actor_id"),
        "occurred_at": time_of_nanos(),
        "time_nano": F.col("time_nano"),
        "container_id": F.col("container_id"),
        "container_name": _filled(snap("container.name"), a("name")),
        "image_id": snap("image.id"),
        "image_ref": _filled(snap("config.image"), a("image"), a("from")),
        "image_digest": snap("image.primary_repo_digest"),
        "image_digest_status": F.when(
            known, F.coalesce(snap("image.digest_status"), F.lit("inspection_failed"))
        ).otherwise("not_applicable"),
        "command": _filled(a("execCommand"), a("command"), detail, configured),
        "container_user": snap("config.user"),
        "attributes": F.col("attributes"),
        "container_snapshot": F.when(known, F.col("snapshot")),
    }
    out = computed_once(rows, row=F.struct(*[c.alias(n) for n, c in columns.items()])).select("row.*")
    return out.withColumn("event_id", lifecycle_event_id()).select("event_id", *columns)


def lifecycle_event_id() -> Column:
    return sha256_fields(
        {
            "docker_host_id": F.col("docker_host_id"),
            "event_type": F.col("event_type"),
            "action": F.col("action"),
            "scope": F.col("scope"),
            "actor_id": F.col("actor_id"),
            "time_nano": F.col("time_nano"),
            "attributes": sorted_map(F.col("attributes")),
        }
    )


def reduce_snapshot(column: str) -> Column:
    """Fields of an inspection that are kept; environment variables are not among them."""
    at = lambda path: F.col(f"{column}.{path}")

    def pick(names: dict[str, str], **filled: Column) -> Column:
        """Fields by their source path; those in ``filled`` have this value where they are absent."""
        values = {name: F.coalesce(at(source), filled[name]) if name in filled else at(source) for name, source in names.items()}
        return F.struct(*[value.alias(name) for name, value in values.items()])

    empty = F.array().cast("array<string>")
    no_devices = F.array().cast("array<struct<PathInContainer:string,CgroupPermissions:string>>")
    digests = F.coalesce(at("ImageDetails.RepoDigests"), empty)
    digest = primary_digest(at("Config.Image"), digests)
    inspected = at("ImageDetails").isNotNull()
    status = (
        F.when(~inspected, "inspection_failed").when(digest.isNotNull(), "resolved").otherwise("unavailable")
    )
    name = F.regexp_replace(at("Name"), "^/+", "")
    return F.struct(
        F.struct(
            at("Id").alias("id"),
            F.when(F.length(name) > 0, name).alias("name"),
            at("Created").alias("created"),
            at("RestartCount").alias("restart_count"),
            at("Platform").alias("platform"),
        ).alias("container"),
        pick(
            {
                "status": "State.Status", "running": "State.Running", "paused": "State.Paused",
                "restarting": "State.Restarting", "oom_killed": "State.OOMKilled", "dead": "State.Dead",
                "pid": "State.Pid", "exit_code": "State.ExitCode", "started_at": "State.StartedAt",
                "finished_at": "State.FinishedAt",
            }
        ).alias("state"),
        pick(
            {
                "image": "Config.Image", "hostname": "Config.Hostname", "user": "Config.User",
                "working_dir": "Config.WorkingDir", "entrypoint": "Config.Entrypoint",
                "command": "Config.Cmd", "labels": "Config.Labels",
            },
            labels=F.create_map().cast("map<string,string>"),
        ).alias("config"),
        pick(
            {
                "privileged": "HostConfig.Privileged", "readonly_rootfs": "HostConfig.ReadonlyRootfs",
                "network_mode": "HostConfig.NetworkMode", "pid_mode": "HostConfig.PidMode",
                "ipc_mode": "HostConfig.IpcMode", "uts_mode": "HostConfig.UTSMode",
                "userns_mode": "HostConfig.UsernsMode", "cap_add": "HostConfig.CapAdd",
                "cap_drop": "HostConfig.CapDrop", "security_opt": "HostConfig.SecurityOpt",
                "devices": "HostConfig.Devices", "port_bindings": "HostConfig.PortBindings",
            },
            cap_add=empty, cap_drop=empty, security_opt=empty, devices=no_devices,
        ).alias("host_config"),
        F.struct(at("NetworkSettings.Ports").alias("ports")).alias("network_settings"),
        F.transform_values(
            at("NetworkSettings.Networks"),
            lambda _, n: F.struct(
                n["NetworkID"].alias("network_id"), n["EndpointID"].alias("endpoint_id"),
                n["Gateway"].alias("gateway"), n["IPAddress"].alias("ip_address"),
                n["GlobalIPv6Address"].alias("global_ipv6_address"),
                F.coalesce(n["Aliases"], empty).alias("aliases"),
            ),
        ).alias("networks"),
        F.transform(
            at("Mounts"),
            lambda m: F.struct(
                m["Type"].alias("type"), m["Source"].alias("source"), m["Destination"].alias("destination"),
                m["Mode"].alias("mode"), m["RW"].alias("rw"), m["Propagation"].alias("propagation"),
            ),
        ).alias("mounts"),
        F.struct(
            F.coalesce(at("ImageDetails.Id"), at("Image")).alias("id"),
            digests.alias("repo_digests"),
            F.coalesce(at("ImageDetails.RepoTags"), empty).alias("repo_tags"),
            digest.alias("primary_repo_digest"),
            status.alias("digest_status"),
            at("ImageDetails.Os").alias("os"),
            at("ImageDetails.Architecture").alias("architecture"),
            at("ImageDetails.Created").alias("created"),
        ).alias("image"),
    )


def repair_actions(events: DataFrame) -> DataFrame:
    """Rewrite old free-text actions to categories and recover commands from them.

    events: action, raw_action, command.  Adds which of the two changed.
    """
    category = action_category(F.coalesce(F.when(F.length("action") > 0, F.col("action")), F.lit("unknown")))
    original = F.coalesce(F.when(F.length("action") > 0, F.col("action")), F.lit("unknown"))
    detail = action_detail(F.col("raw_action"))
    recover = category.isin("exec_create", "exec_start") & detail.isNotNull()
    fixes = recover & ~F.col("command").eqNullSafe(detail)
    return events.withColumns(
        {
            "action_repaired": category != original,
            "command_repaired": F.coalesce(fixes, F.lit(False)),
            "command": F.when(recover, detail).otherwise(F.col("command")),
            "action": category,
        }
    )


# --- retention ---------------------------------------------------------------------------


def retention_plan(tables: dict[str, DataFrame], cutoff: Column) -> DataFrame:
    """(name, eligible): rows older than the cutoff per table."""
    out = None
    for name, frame in tables.items():
        part = frame.agg(F.count_if(F.col("occurred_at") < cutoff).alias("eligible"))
        part = part.select(F.lit(name).alias("name"), "eligible")
        out = part if out is None else out.unionByName(part)
    return out


def expire_batch(events: DataFrame, cutoff: Column, batch: int) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted) after removing at most ``batch`` of the oldest expired rows."""
    expired = events.where(F.col("occurred_at") < cutoff)
    oldest = expired.orderBy("occurred_at", "event_id").limit(batch).select("event_id")
    return events.join(oldest, "event_id", "left_anti"), events.join(oldest, "event_id", "left_semi")
