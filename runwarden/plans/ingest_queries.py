"""Queries for raw lines, cleaning, dead letters, contexts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden import schemas
from runwarden.functions import context, documents, hashing
from runwarden.functions import text as clean
from runwarden.functions.frames import computed_once
from runwarden.operators import normalize
from runwarden.operators.profile import exec_tokens
from runwarden.plans.registry import query
from runwarden.plans.views import CUT_US, DAY_US, Tables, duck_prefix
from runwarden.sources import readers, sinks

SENSOR, RULE, HOST = "sensor-1", "Process started", "host-1"


def text(c: F.Column) -> F.Column:
    return c.cast("string")


# --- sensor lines ------------------------------------------------------------------------

LINES_SQL = """ln AS (SELECT *, CASE WHEN n % 37 = 0 THEN 'Other' ELSE 'Process started' END AS rule,
    CASE WHEN n % 41 = 0 THEN 'audit' WHEN n % 3 = 0 THEN NULL ELSE 'syscall' END AS source,
    CASE WHEN n % 43 = 0 THEN 'host' WHEN n % 10 = 0 THEN '<NA>' ELSE substr(container_id, 1, 12) END AS cid,
    n % 47 = 0 AS no_pid, n % 53 = 0 AS no_time, n % 59 = 0 AS broken FROM ex),
  cls AS (SELECT *, CASE WHEN broken THEN 'malformed' WHEN rule <> 'Process started' OR coalesce(source, 'syscall') <> 'syscall'
      THEN 'ignored' WHEN no_time OR no_pid THEN 'error' WHEN cid = 'host' THEN 'ignored' ELSE 'ok' END AS outcome FROM ln),
  acc AS (SELECT *, nullif(cid, '<NA>') AS rcid FROM cls WHERE outcome = 'ok'),
  nev AS (SELECT n, sha256('{"command_line":' || coalesce(cast(to_json(command_line) AS varchar), 'null') || ',"container_id":'
      || coalesce('"' || rcid || '"', 'null') || ',"event_number":' || n || ',"event_type":"execve","process_pid":' || process_pid
      || ',"process_ppid":' || coalesce(cast(process_ppid AS varchar), 'null') || ',"sensor_instance_id":"sensor-1","time_nano":'
      || time_nano || '}') AS event_id, us, rcid AS reported_container_id, process_name, executable, user_uid, process_ppid FROM acc)"""


def sensor_lines(t: Tables) -> DataFrame:
    """(n, raw): the executions as a sensor would have written them, flaws included."""
    n = F.col("n")
    iso = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    fields = F.map_filter(
        F.create_map(
            F.lit("evt.rawtime"), F.when((n % 2 == 0) & (n % 53 > 0), text(F.col("time_nano"))),
            F.lit("evt.num"), text(n),
            F.lit("container.id"), F.when(n % 43 == 0, "host").when(n % 10 == 0, "<NA>").otherwise(F.substring("container_id", 1, 12)),
            F.lit("container.image.repository"), F.concat(F.lit("repo/app"), text(F.col("g"))),
            F.lit("container.image.tag"), F.when(n % 4 > 0, F.lit("v1")),
            F.lit("proc.pid"), F.when(n % 47 == 0, "-5").otherwise(text(F.col("process_pid"))),
            F.lit("proc.ppid"), F.coalesce(text(F.col("process_ppid")), F.lit("N/A")),
            F.lit("proc.name"), F.coalesce("process_name", F.lit("<NA>")),
            F.lit("proc.exepath"), F.coalesce("executable", F.lit("")),
            F.lit("proc.cmdline"), F.col("command_line"),
            F.lit("user.uid"), F.coalesce(text(F.col("user_uid")), F.lit("null")),
        ),
        lambda _, v: v.isNotNull(),
    )
    time = F.when(n % 53 == 0, "yesterday").otherwise(
        F.concat(iso, F.element_at(F.array(*map(F.lit, ("Z", "+00:00", "+0000"))), (n % 3 + 1).cast("int")))
    )
    line = F.to_json(
        F.struct(
            F.when(n % 37 == 0, "Other").otherwise(RULE).alias("rule"),
            F.when(n % 41 == 0, "audit").when(n % 3 > 0, "syscall").alias("source"),
            time.alias("time"),
            F.array(F.lit("a"), F.lit(""), F.lit("None"), F.lit("b")).alias("tags"),
            fields.alias("output_fields"),
        )
    )
    raw = F.when(n % 59 == 0, F.substring(line, 1, 40)).otherwise(line)
    execs = t.execs_of(t.base_of(t.spread(t.raw("events"))))
    return execs.select("n", raw.alias("raw"))


@query(
    "nrm1_normalize_exec",
    duck_prefix("ex") + "," + LINES_SQL + """ SELECT event_id, us, n AS event_number, reported_container_id, process_name, executable,
      user_uid, process_ppid FROM nev""",
)
def normalize_exec(t: Tables) -> DataFrame:
    events, _ = normalize.normalize_exec_lines(sensor_lines(t).select("raw"), SENSOR, RULE, HOST)
    names = ["event_number", "reported_container_id", "process_name", "executable", "user_uid", "process_ppid"]
    return events.select("event_id", F.unix_micros("occurred_at").alias("us"), *names)


@query(
    "nrm7_exec_event_id",
    duck_prefix("ex") + "," + LINES_SQL + " SELECT event_id, count(*) AS n FROM nev GROUP BY 1",
)
def exec_event_id(t: Tables) -> DataFrame:
    events, _ = normalize.normalize_exec_lines(sensor_lines(t).select("raw"), SENSOR, RULE, HOST)
    return events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg24_ingest_counters",
    duck_prefix("ex") + "," + LINES_SQL + """ SELECT count(*) AS lines, count(*) FILTER (outcome = 'ignored') AS ignored,
      count(*) FILTER (outcome IN ('malformed', 'error')) AS malformed, count(*) FILTER (outcome = 'ok') AS enqueued,
      0::bigint AS duplicates FROM cls""",
)
def ingest_counters(t: Tables) -> DataFrame:
    classified = normalize.classify_sensor_lines(sensor_lines(t).select("raw"), RULE)
    return normalize.ingest_counters(classified, normalize.exec_events(classified, SENSOR, HOST))


@query(
    "nrm17_dead_letter_classes",
    duck_prefix("ex") + "," + LINES_SQL + """ SELECT CASE outcome WHEN 'malformed' THEN 'JSONDecodeError' ELSE 'ValueError' END AS error_class,
      count(*) AS n FROM cls WHERE outcome IN ('malformed', 'error') GROUP BY 1""",
)
def dead_letter_classes(t: Tables) -> DataFrame:
    _, rejected = normalize.normalize_exec_lines(sensor_lines(t).select("raw"), SENSOR, RULE, HOST)
    return rejected.groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))


# --- cleaning ----------------------------------------------------------------------------

ODD_SQL = """CASE user_id % 8 WHEN 0 THEN '' WHEN 1 THEN '<NA>' WHEN 2 THEN 'N/A' WHEN 3 THEN 'null' WHEN 4 THEN 'None'
  WHEN 5 THEN '-' || event_id WHEN 6 THEN event_type || event_id ELSE cast(event_id AS varchar) END"""


def odd_values(t: Tables) -> DataFrame:
    u, n = F.col("user_id") % 8, text(F.col("event_id"))
    value = F.when(u == 0, "")
    for slot, word in enumerate(("<NA>", "N/A", "null", "None"), start=1):
        value = value.when(u == slot, word)
    value = value.when(u == 5, F.concat(F.lit("-"), n)).when(u == 6, F.concat("event_type", n)).otherwise(n)
    return t.raw("events").select("event_id", value.alias("value"))


@query("nrm2_na_cleaning", f"SELECT event_id, CASE WHEN v NOT IN ('', '<NA>', 'N/A', 'null', 'None') THEN v END AS value FROM (SELECT event_id, {ODD_SQL} AS v FROM events)")
def na_cleaning(t: Tables) -> DataFrame:
    return odd_values(t).withColumn("value", clean.clean(F.col("value")))


@query("nrm3_text_clip", "SELECT doc_id, substr(text, 1, 255) AS clipped FROM documents")
def text_clip(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", clean.clip(F.col("text"), 255).alias("clipped"))


@query("nrm4_non_negative_int", f"SELECT event_id, CASE WHEN try_cast(v AS bigint) >= 0 THEN try_cast(v AS bigint) END AS value FROM (SELECT event_id, {ODD_SQL} AS v FROM events)")
def non_negative_int(t: Tables) -> DataFrame:
    return odd_values(t).withColumn("value", clean.non_negative_int(F.col("value")))


@query(
    "nrm5_event_time",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id * 1000 WHEN event_id % 5 = 4 THEN NULL
      WHEN event_id % 5 = 3 THEN (epoch_us(ts) // 1000000 - 19800) * 1000000000 + 123456789
      ELSE epoch_us(ts) * 1000 END AS time_nano FROM events""",
)
def event_time(t: Tables) -> DataFrame:
    k, at = F.col("event_id") % 5, F.col("ts").cast("timestamp")
    base = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, ".SSSSSS")
    iso = (
        F.when(k == 1, F.concat(base, micros, F.lit("Z")))
        .when(k == 2, F.concat(base, micros, F.lit("000+0000")))
        .when(k == 3, F.concat(base, F.lit(".1234567891+05:30")))
        .otherwise("2024-13-45T00:00:00Z")
    )
    raw = F.when(k == 0, text(F.col("event_id") * 1000)).otherwise("N/A")
    return t.raw("events").select("event_id", normalize.event_nanos(raw, iso).alias("time_nano"))


@query("nrm6_image_ref", """SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_size % 2 = 0 THEN p_brand || ':' || p_type
    ELSE p_brand END END AS image_ref FROM part""")
def image_ref(t: Tables) -> DataFrame:
    repository = F.when(F.col("p_size") % 3 > 0, F.col("p_brand"))
    tag = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return t.raw("part").select("p_partkey", clean.image_reference(repository, tag).alias("image_ref"))


@query(
    "nrm8_tags",
    """SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: x NOT IN ('', '<NA>', 'N/A', 'null', 'None')), '|') AS tags FROM documents""",
)
def tags(t: Tables) -> DataFrame:
    words = clean.tag_list(F.split("text", " "))
    return t.raw("documents").select("doc_id", F.array_join(words, "|").alias("tags"))


ACTION_SQL = """CASE user_id % 5 WHEN 0 THEN ' Exec_Create: /bin/sh -c ' || event_id WHEN 1 THEN event_type WHEN 2 THEN ' : x'
  WHEN 3 THEN 'health_status: ' ELSE event_type || ':a:b ' END"""


def actions(t: Tables) -> F.Column:
    u, n, kind = F.col("user_id") % 5, text(F.col("event_id")), F.col("event_type")
    return (
        F.when(u == 0, F.concat(F.lit(" Exec_Create: /bin/sh -c "), n))
        .when(u == 1, kind)
        .when(u == 2, " : x")
        .when(u == 3, "health_status: ")
        .otherwise(F.concat(kind, F.lit(":a:b ")))
    )


@query(
    "nrm10_action_parts",
    f"""SELECT event_id, coalesce(nullif(trim(lower(split_part(trim(a), ':', 1))), ''), 'unknown') AS category,
      nullif(trim(CASE WHEN contains(a, ':') THEN substr(a, strpos(a, ':') + 1) END), '') AS detail
    FROM (SELECT event_id, {ACTION_SQL} AS a FROM events)""",
)
def action_parts(t: Tables) -> DataFrame:
    action = actions(t)
    return t.raw("events").select(
        "event_id", clean.action_category(action).alias("category"), clean.action_detail(action).alias("detail")
    )


@query(
    "nrm19_action_repair",
    f"""WITH a AS (SELECT event_id, {ACTION_SQL} AS action, CASE WHEN event_id % 2 = 0 THEN '/bin/sh -c ' || event_id END AS command FROM events),
      b AS (SELECT *, coalesce(nullif(trim(lower(split_part(trim(action), ':', 1))), ''), 'unknown') AS c,
        nullif(trim(CASE WHEN contains(action, ':') THEN substr(action, strpos(action, ':') + 1) END), '') AS d FROM a)
    SELECT event_id, c AS action, CASE WHEN c = 'exec_create' AND d IS NOT NULL THEN d ELSE command END AS command,
      c <> action AS action_repaired, c = 'exec_create' AND d IS NOT NULL AND command IS DISTINCT FROM d AS command_repaired FROM b""",
)
def action_repair(t: Tables) -> DataFrame:
    n = F.col("event_id")
    rows = t.raw("events").select(
        "event_id",
        actions(t).alias("action"),
        actions(t).alias("raw_action"),
        F.when(n % 2 == 0, F.concat(F.lit("/bin/sh -c "), text(n))).alias("command"),
    )
    return normalize.repair_actions(rows).drop("raw_action")


REFS_SQL = """CASE p_size % 6 WHEN 0 THEN 'docker.io/library/app' || (p_partkey % 5) || ':3.20' WHEN 1 THEN 'localhost:5000/x/app' || (p_partkey % 5)
  WHEN 2 THEN 'library/app' || (p_partkey % 5) || '@sha256:abc' WHEN 3 THEN 'app' || (p_partkey % 5) WHEN 4 THEN NULL
  ELSE 'ghcr.io/o/app:1' END"""
BARE_SQL = """regexp_replace(regexp_replace(regexp_replace(split_part({0}, '@', 1), ':[^/:]*$', ''), '^docker\\.io/', ''), '^library/', '')"""


def image_refs() -> F.Column:
    size, app = F.col("p_size") % 6, F.concat(F.lit("app"), text(F.col("p_partkey") % 5))
    return (
        F.when(size == 0, F.concat(F.lit("docker.io/library/"), app, F.lit(":3.20")))
        .when(size == 1, F.concat(F.lit("localhost:5000/x/"), app))
        .when(size == 2, F.concat(F.lit("library/"), app, F.lit("@sha256:abc")))
        .when(size == 3, app)
        .when(size == 5, "ghcr.io/o/app:1")
    )


@query("nrm13_canonical_repository", f"SELECT p_partkey, {BARE_SQL.format('r')} AS repository FROM (SELECT p_partkey, {REFS_SQL} AS r FROM part)")
def canonical_repository(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", clean.canonical_repository(image_refs()).alias("repository"))


@query(
    "nrm14_primary_digest",
    f"""WITH r AS (SELECT p_partkey, {REFS_SQL} AS r, ['z/app@sha256:' || p_partkey, 'app' || (p_partkey % 3) || '@sha256:1', 'noise:1',
        'app' || (p_partkey % 3) || '@sha256:0'] AS ds FROM part),
      p AS (SELECT p_partkey, r, unnest(list_sort(list_distinct(list_filter(ds, lambda d: contains(d, '@sha256:'))))) AS d FROM r)
    SELECT p_partkey, coalesce(min(d) FILTER ({BARE_SQL.format('d')} = {BARE_SQL.format('r')}), min(d)) AS digest FROM p GROUP BY 1""",
)
def primary_digest(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    app = F.concat(F.lit("app"), text(key % 3))
    digests = F.array(
        F.concat(F.lit("z/app@sha256:"), text(key)),
        F.concat(app, F.lit("@sha256:1")),
        F.lit("noise:1"),
        F.concat(app, F.lit("@sha256:0")),
    )
    return t.raw("part").select("p_partkey", clean.primary_digest(image_refs(), digests).alias("digest"))


SECRETS = r"(?:token|password|passwd|secret|api[_-]?key|authorization)"


def redact_sql(column: str) -> str:
    rules = [
        (rf"([\"'']{SECRETS}[\"'']\s*:\s*)(?:\"[^\"]*\"|''[^'']*''|[^,\s}}]+)", r'\1"<redacted>"'),
        (rf"\b({SECRETS[:1]}{SECRETS[3:]})\s*=\s*(?:\"[^\"]*\"|''[^'']*''|\S+)", r"\1=<redacted>"),
        (rf"(--{SECRETS})(?:=|\s+)\S+", r"\1=<redacted>"),
        (r"\bbearer\s+\S+", "Bearer <redacted>"),
    ]
    for pattern, replacement in rules:
        column = f"regexp_replace({column}, '{pattern}', '{replacement}', 'gi')"
    return column


# Every document gets a line with secrets in front, so that each pattern has work.
LEAKY_SQL = """'"apiKey":"k' || doc_id || '" token="super ' || doc_id || '" --password hunter' || doc_id || ' Bearer b' || doc_id
  || ' --api-key=z authorization = y π' || chr(10) || text"""


def leaky(t: Tables) -> F.Column:
    n = text(F.col("doc_id"))
    return F.concat(
        F.lit('"apiKey":"k'), n, F.lit('" token="super '), n, F.lit('" --password hunter'), n,
        F.lit(" Bearer b"), n, F.lit(" --api-key=z authorization = y π\n"), F.col("text"),
    )


@query("nrm15_redaction", f"SELECT doc_id, {redact_sql('(' + LEAKY_SQL + ')')} AS redacted FROM documents")
def redaction(t: Tables) -> DataFrame:
    return t.spread(t.raw("documents")).select("doc_id", clean.redact(leaky(t)).alias("redacted"))


CLIP_SQL = "left({0}, list_max(list_filter(range(0, {1} + 1), lambda i: strlen(left({0}, i)) <= {1})))"


@query("nrm16_utf8_clip", f"SELECT doc_id, {CLIP_SQL.format('text', 301)} AS clipped FROM documents")
def utf8_clip(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", clean.clip_utf8(F.col("text"), 301).alias("clipped"))


@query(
    "nrm17_dead_letters",
    f"""WITH r AS (SELECT doc_id AS id, text AS raw, {redact_sql('text')} AS red,
        CASE WHEN doc_id % 3 = 0 THEN 'NoMessage' ELSE 'ValueError: bad token=abc' || doc_id || ' ' || text END AS e FROM documents)
    SELECT id, sha256(raw) AS raw_sha256, strlen(raw) AS raw_byte_length, {CLIP_SQL.format('red', 512)} AS excerpt,
      split_part(e, ':', 1) AS error_class, CASE WHEN contains(e, ':') THEN m ELSE '' END AS error_message
    FROM (SELECT *, {redact_sql("trim(substr(e, strpos(e, ':') + 1))")} AS m FROM r)""",
)
def dead_letters(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    error = F.when(n % 3 == 0, "NoMessage").otherwise(
        F.concat(F.lit("ValueError: bad token=abc"), text(n), F.lit(" "), "text")
    )
    rows = t.spread(t.raw("documents")).select(n.alias("id"), F.col("text").alias("raw"), error.alias("error"))
    return normalize.dead_letters(rows)


RETENTION_SQL = f"""dl AS (SELECT event_id AS id, epoch_us(ts) AS rec_us, repeat('x', cast(event_id % 97 AS integer)) AS excerpt FROM events),
  fr AS (SELECT *, row_number() OVER (ORDER BY rec_us DESC, id DESC) AS rn, sum(strlen(excerpt)) OVER (ORDER BY rec_us DESC, id DESC
    ROWS UNBOUNDED PRECEDING) AS total FROM dl WHERE rec_us >= {CUT_US - 5 * DAY_US}),
  kept AS (SELECT * FROM fr WHERE rn <= (SELECT count(*) * 3 / 10 FROM dl) AND total <= (SELECT count(*) * 12 FROM dl))"""


def letters(t: Tables) -> tuple[DataFrame, DataFrame]:
    events = t.raw("events")
    total = events.count()
    rows = events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("recorded_at"),
        F.expr("repeat('x', cast(event_id % 97 AS int))").alias("excerpt"),
    )
    cutoff = F.timestamp_micros(F.lit(CUT_US - 5 * DAY_US))
    return rows, normalize.retain_dead_letters(rows, cutoff, total * 3 // 10, total * 12)


@query("nrm18_dead_letter_retention", "WITH " + RETENTION_SQL + " SELECT id FROM kept")
def dead_letter_retention(t: Tables) -> DataFrame:
    return letters(t)[1].select("id")


@query(
    "agg24_dead_letter_stats",
    "WITH " + RETENTION_SQL + """ SELECT (SELECT count(*) FROM dl) AS inserted, count(*) AS retained_count,
      cast(sum(strlen(excerpt)) AS bigint) AS retained_bytes, (SELECT count(*) FROM dl) - count(*) AS evicted FROM kept""",
)
def dead_letter_stats(t: Tables) -> DataFrame:
    return normalize.dead_letter_stats(*letters(t))


# --- lifecycle lines ---------------------------------------------------------------------

LIFE_SQL = """lf AS (SELECT *, CASE WHEN n % 4 = 0 THEN action || ': cmd ' || k ELSE action END AS raw_action,
    CASE WHEN n % 9 = 0 THEN NULL ELSE 'container' END AS knd, n % 2 = 0 AS upper_keys FROM lc),
  lo AS (SELECT n, coalesce(knd, event_type) AS event_type, action, time_nano, us,
    CASE WHEN coalesce(knd, event_type) = 'container' THEN container_id
      WHEN n % 3 = 0 THEN 'net-' || u END AS container_id, container_id AS actor_id,
    coalesce(container_name, 'x') AS nm, raw_action, k, u FROM lf)"""

LIFE_ID = """sha256('{"action":"' || action || '","actor_id":"' || actor_id || '","attributes":{'
      || concat_ws(',', CASE WHEN n % 3 = 0 THEN '"container":"net-' || u || '"' END, '"image":"' || ir || '"', '"name":"' || nm || '"')
      || '},"docker_host_id":"host-1","event_type":"' || event_type || '","scope":null,"time_nano":' || time_nano || '}') AS event_id"""


def lifecycle_lines(t: Tables) -> DataFrame:
    """Lifecycle events as JSON lines with keys in both spellings."""
    n, k = F.col("n"), F.col("k")
    kind = F.when(n % 9 > 0, "Container").otherwise(F.initcap("event_type"))
    raw_action = F.when(n % 4 == 0, F.concat("action", F.lit(": cmd "), text(k))).otherwise(F.col("action"))
    attributes = F.map_filter(
        F.create_map(
            F.lit("name"), F.coalesce("container_name", F.lit("x")),
            F.lit("image"), F.col("image_ref"),
            F.lit("container"), F.when(n % 3 == 0, F.concat(F.lit("net-"), text(F.col("u")))),
        ),
        lambda _, v: v.isNotNull(),
    )
    upper = F.to_json(
        F.struct(
            kind.alias("Type"),
            raw_action.alias("Action"),
            F.struct(F.col("container_id").alias("ID"), attributes.alias("Attributes")).alias("Actor"),
            F.col("time_nano").alias("timeNano"),
        )
    )
    lower = F.to_json(
        F.struct(
            kind.alias("type"),
            raw_action.alias("status"),
            F.struct(F.col("container_id").alias("Id"), attributes.alias("attributes")).alias("actor"),
            F.col("time_nano").alias("TimeNano"),
        )
    )
    rows = t.lifecycle_of(t.base_of(t.spread(t.raw("events"))))
    return rows.select("n", F.when(n % 2 == 0, upper).otherwise(lower).alias("raw"), inspection_document().alias("inspection"))


def inspection_document() -> F.Column:
    """A container inspection as JSON text, derived from a lifecycle row."""
    k, g = F.col("k"), text(F.col("g"))
    binding = F.array(
        F.struct(
            F.when(k % 3 == 0, "127.0.0.1").when(k % 3 == 1, "").otherwise("10.0.0.1").alias("HostIp"),
            F.when(k % 2 == 0, "8080").otherwise("").alias("HostPort"),
        )
    )
    return F.to_json(
        F.struct(
            F.col("container_id").alias("Id"),
            F.concat(F.lit("/"), F.coalesce("container_name", F.lit("anon"))).alias("Name"),
            F.col("image_id").alias("Image"),
            F.struct(F.lit("running").alias("Status"), (k % 2 == 0).alias("Running")).alias("State"),
            F.struct(
                F.col("image_ref").alias("Image"),
                F.when(k % 4 == 0, "root:0").when(k % 4 == 1, "app").when(k % 4 == 2, "").alias("User"),
                F.array(F.lit("/bin/run")).alias("Entrypoint"),
                F.array(
                    F.lit("/usr/bin/sérver"), F.lit("--port=80"), F.lit("--API-Key"), F.lit("abc"), F.lit("-v"),
                    text(k), F.lit("./data"), F.lit("http://h/x"), text(k), F.lit("word"), F.lit("--token=t"),
                    F.lit("--empty="), F.lit("z"),
                ).alias("Cmd"),
                F.array(F.lit("PASSWORD=x")).alias("Env"),
                F.create_map(F.lit("53/udp"), F.create_map()).cast("map<string,map<string,string>>").alias("ExposedPorts"),
            ).alias("Config"),
            F.struct(
                F.when(k % 7 > 0, k < 3).alias("Privileged"),
                (k % 2 == 0).alias("ReadonlyRootfs"),
                F.element_at(
                    F.array(*map(F.lit, ("host", "none", "default", "bridge", "container:x", "net-1", ""))),
                    (k % 7 + 1).cast("int"),
                ).alias("NetworkMode"),
                F.array(F.lit("cap_net_raw"), F.lit("SYS_ADMIN"), F.lit("CAP_NET_RAW")).alias("CapAdd"),
                F.create_map(F.lit("80/tcp"), binding).alias("PortBindings"),
                F.create_map(F.lit("/scratch"), F.lit("")).alias("Tmpfs"),
            ).alias("HostConfig"),
            F.array(
                F.struct(F.lit("Bind").alias("Type"), F.lit("/data").alias("Destination"), (k % 2 == 0).alias("RW"))
            ).alias("Mounts"),
            F.struct(
                F.col("image_id").alias("Id"),
                F.when(
                    k % 10 > 0,
                    F.array(F.concat(F.lit("repo/app"), g, F.lit("@sha256:d"), g), F.concat(F.lit("a/other@sha256:0"), g)),
                ).alias("RepoDigests"),
            ).alias("ImageDetails"),
        )
    )



@query(
    "nrm9_normalize_lifecycle",
    duck_prefix("lc") + "," + LIFE_SQL + """ SELECT us, event_type, action, actor_id, container_id,
      CASE WHEN container_id IS NULL THEN nm ELSE coalesce(cn, 'anon') END AS container_name,
      CASE WHEN container_id IS NULL THEN 'not_applicable' WHEN k % 10 > 0 THEN 'resolved' ELSE 'unavailable' END AS image_digest_status,
      CASE WHEN container_id IS NOT NULL AND k % 10 > 0 THEN CASE WHEN ir IS NULL THEN 'a/other@sha256:0' || g ELSE 'repo/app' || g || '@sha256:d' || g END END AS image_digest,
      CASE WHEN action IN ('exec_create', 'exec_start') AND contains(raw_action, ':') THEN 'cmd ' || k
        WHEN container_id IS NOT NULL THEN '/usr/bin/sérver --port=80 --API-Key abc -v ' || k || ' ./data http://h/x ' || k || ' word --token=t --empty= z'
        END AS command
    FROM lo JOIN (SELECT n, container_name AS cn, image_ref AS ir, g FROM lc) USING (n)""",
)
def normalize_lifecycle(t: Tables) -> DataFrame:
    out = normalize.lifecycle_events(lifecycle_lines(t).select("raw", "inspection"), HOST)
    names = ["event_type", "action", "actor_id", "container_id", "container_name", "image_digest_status", "image_digest", "command"]
    return out.select(F.unix_micros("occurred_at").alias("us"), *names)


@query(
    "nrm11_lifecycle_event_id",
    duck_prefix("lc") + "," + LIFE_SQL + """ SELECT """ + LIFE_ID + """,
      time_nano, action FROM lo JOIN (SELECT n, image_ref AS ir FROM lc) USING (n)""",
)
def lifecycle_event_ids(t: Tables) -> DataFrame:
    out = normalize.lifecycle_events(lifecycle_lines(t).select("raw"), HOST)
    return out.select("event_id", "time_nano", "action")


SNAPSHOT_SQL = """'{"container":{"id":"' || actor_id || '","name":"' || coalesce(cn, 'anon') || '"},"state":{"status":"running","running":'
      || (k % 2 = 0) || '},"config":{' || concat_ws(',', '"image":"' || ir || '"',
        '"user":"' || CASE k % 4 WHEN 0 THEN 'root:0' WHEN 1 THEN 'app' WHEN 2 THEN '' END || '"',
        '"entrypoint":["/bin/run"],"command":["/usr/bin/sérver","--port=80","--API-Key","abc","-v","' || k
          || '","./data","http://h/x","' || k || '","word","--token=t","--empty=","z"],"labels":{}')
      || '},"host_config":{' || concat_ws(',', '"privileged":' || CASE WHEN k % 7 > 0 THEN k < 3 END, '"readonly_rootfs":' || (k % 2 = 0),
        '"network_mode":"' || ['host', 'none', 'default', 'bridge', 'container:x', 'net-1', ''][k % 7 + 1]
          || '","cap_add":["cap_net_raw","SYS_ADMIN","CAP_NET_RAW"],"cap_drop":[],"security_opt":[],"devices":[]')
      || ',"port_bindings":{"80/tcp":[{"HostIp":"' || CASE k % 3 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '' ELSE '10.0.0.1' END
      || '","HostPort":"' || CASE WHEN k % 2 = 0 THEN '8080' ELSE '' END || '"}]}},"network_settings":{},"mounts":[{"type":"Bind","destination":"/data","rw":'
      || (k % 2 = 0) || '}],"image":{' || concat_ws(',', '"id":"' || iid || '"',
        CASE WHEN k % 10 > 0 THEN '"repo_digests":["repo/app' || g || '@sha256:d' || g || '","a/other@sha256:0' || g || '"]'
          ELSE '"repo_digests":[]' END, '"repo_tags":[]',
        CASE WHEN k % 10 > 0 THEN '"primary_repo_digest":"' || CASE WHEN ir IS NULL THEN 'a/other@sha256:0' || g
          ELSE 'repo/app' || g || '@sha256:d' || g END || '"' END,
        '"digest_status":"' || CASE WHEN k % 10 > 0 THEN 'resolved' ELSE 'unavailable' END || '"') || '}}'"""


@query(
    "nrm12_snapshot_reduction",
    duck_prefix("lc") + "," + LIFE_SQL + f""" SELECT {LIFE_ID}, {SNAPSHOT_SQL} AS snapshot
    FROM lo JOIN (SELECT n, container_name AS cn, image_ref AS ir, image_id AS iid, g FROM lc) USING (n) WHERE container_id IS NOT NULL""",
)
def snapshot_reduction(t: Tables) -> DataFrame:
    out = normalize.lifecycle_events(lifecycle_lines(t).select("raw", "inspection"), HOST)
    return out.where("container_snapshot IS NOT NULL").select(
        "event_id", F.to_json("container_snapshot").alias("snapshot")
    )


@query("src2_lifecycle_types", duck_prefix("lc") + f" SELECT event_id FROM lc WHERE event_type IN ('container', 'network') AND us >= {CUT_US - 2000000}")
def lifecycle_types(t: Tables) -> DataFrame:
    return readers.reread_overlap(readers.keep_lifecycle_types(t.lifecycle), CUT_US).select("event_id")


# --- sinks -------------------------------------------------------------------------------


def _append_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A stored table and a batch that overlaps it and repeats itself."""
    stored = t.execs.where("n % 3 = 0").select("event_id", "us")
    batch = t.execs.where("n % 2 = 0 OR n % 3 > 0").select("event_id", "us")
    return stored, batch.unionByName(batch.where("us % 5 = 0"))


APPEND_SQL = """st AS (SELECT event_id, us FROM ex WHERE n % 3 = 0),
  ba AS (SELECT event_id, us FROM ex WHERE n % 2 = 0 OR n % 3 > 0
    UNION ALL SELECT event_id, us FROM ex WHERE (n % 2 = 0 OR n % 3 > 0) AND us % 5 = 0)"""


@query("snk1_idempotent_append", duck_prefix("ex") + "," + APPEND_SQL + " SELECT DISTINCT event_id, us FROM ba WHERE event_id NOT IN (SELECT event_id FROM st)")
def idempotent_append(t: Tables) -> DataFrame:
    stored, batch = _append_parts(t)
    return sinks.new_rows(batch, stored)


@query("snk1_append_counts", duck_prefix("ex") + "," + APPEND_SQL + """ SELECT r AS received, i AS inserted, r - i AS duplicates FROM (SELECT (SELECT count(*) FROM ba) AS r,
    (SELECT count(DISTINCT event_id) FROM ba WHERE event_id NOT IN (SELECT event_id FROM st)) AS i)""")
def append_counts(t: Tables) -> DataFrame:
    stored, batch = _append_parts(t)
    return sinks.append_counts(batch, stored)


@query(
    "snk4_replay_check",
    duck_prefix("ex") + """, a AS (SELECT container_id, count(*) AS n FROM ex GROUP BY 1), b AS (SELECT container_id, n + (n % 2) AS n FROM a)
    SELECT *, 'recomputed' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    UNION ALL SELECT *, 'recorded' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def replay_check(t: Tables) -> DataFrame:
    recomputed = t.execs.groupBy("container_id").agg(F.count(F.lit(1)).alias("n"))
    recorded = recomputed.withColumn("n", F.col("n") + F.col("n") % 2)
    return sinks.differences(recomputed, recorded)


@query("str11_retention_plan", duck_prefix("ex", "lc") + f""" SELECT 'process_exec_events' AS name, count(*) FILTER (us < {CUT_US}) AS eligible FROM ex
    UNION ALL SELECT 'runtime_events', count(*) FILTER (us < {CUT_US}) FROM lc""")
def retention_plan(t: Tables) -> DataFrame:
    cutoff = F.timestamp_micros(F.lit(CUT_US))
    return normalize.retention_plan({"process_exec_events": t.execs, "runtime_events": t.lifecycle}, cutoff)


@query("srt4_bounded_delete", duck_prefix("ex") + f""", old AS (SELECT event_id FROM ex WHERE us < {CUT_US} ORDER BY us, event_id LIMIT 1000)
    SELECT event_id FROM ex WHERE event_id NOT IN (SELECT event_id FROM old)""")
def bounded_delete(t: Tables) -> DataFrame:
    kept, _ = normalize.expire_batch(t.execs, F.timestamp_micros(F.lit(CUT_US)), 1000)
    return kept.select("event_id")


# --- scalar functions and contexts -------------------------------------------------------


@query(
    "fn1_canonical_json_hash",
    """SELECT o_orderkey, sha256('{"a":' || o_orderkey || ',"b":"' || o_orderstatus || '","c":' || CASE WHEN o_orderkey % 2 = 0
      THEN '"' || o_orderpriority || '"' ELSE 'null' END || '}') AS hash FROM orders""",
)
def canonical_json_hash(t: Tables) -> DataFrame:
    third = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    fields = {"c": third, "a": F.col("o_orderkey"), "b": F.col("o_orderstatus")}
    return t.raw("orders").select("o_orderkey", hashing.sha256_fields(fields).alias("hash"))


@query(
    "fn3_argv_shape",
    """SELECT page_id, 'exe:' || regexp_extract(url, '[^/]*$') || '|flag:--out|<flag-value>|<url>|flag:<secret>|<secret-value>|'
      || CASE WHEN page_id % 2 = 0 THEN '<integer>' ELSE '<path>' END || '|<positional>|flag:-n|<flag-value>|flag:<secret>|<secret-value>' AS shape FROM pages""",
)
def argv_shape(t: Tables) -> DataFrame:
    n = F.col("page_id")
    argv = F.array(
        F.col("url"), F.lit("--Out"), F.col("url"), F.col("url"), F.lit("--api-key"), text(n),
        F.when(n % 2 == 0, text(n)).otherwise(F.concat(F.lit("../"), text(n))),
        F.lit("v1"), F.lit("-n=4"), F.lit("--my-TOKEN=x"),
    )
    shape = F.array_join(context.argv_shape(argv), "|")
    return t.raw("pages").select("page_id", shape.alias("shape"))


NETWORK_SQL = """CASE k % 7 WHEN 0 THEN 'host' WHEN 1 THEN 'none' WHEN 2 THEN 'bridge' WHEN 3 THEN 'bridge' WHEN 4 THEN 'container'
  WHEN 5 THEN 'user-defined' END"""


def contexts(t: Tables) -> DataFrame:
    rows = t.lifecycle_of(t.base_of(t.spread(t.raw("events"))))
    rows = rows.select("event_id", inspection_document().alias("inspection"))
    rows = context.composed(rows, "inspection")
    parsed = computed_once(rows, i=F.from_json("inspection", schemas.INSPECTION))
    return computed_once(parsed, context=context.runtime_context("i")).select("event_id", "context")


@query("fn4_network_class", duck_prefix("lc") + f" SELECT event_id, {NETWORK_SQL} AS network_mode FROM lc")
def network_class(t: Tables) -> DataFrame:
    return contexts(t).select("event_id", "context.network_mode")


@query("fn5_capability_set", duck_prefix("lc") + " SELECT event_id, 'NET_RAW,SYS_ADMIN' AS added, '' AS dropped FROM lc")
def capability_set(t: Tables) -> DataFrame:
    rows = contexts(t)
    return rows.select(
        "event_id",
        F.array_join("context.capabilities.add", ",").alias("added"),
        F.array_join("context.capabilities.drop", ",").alias("dropped"),
    )


@query(
    "fn6_ports_and_mounts",
    duck_prefix("lc") + """ SELECT event_id, '53/udp/none,80/tcp/' || CASE k % 3 WHEN 0 THEN 'loopback' WHEN 1 THEN 'wildcard' ELSE 'specific' END
      || CASE WHEN k % 2 = 0 THEN '-fixed' ELSE '-ephemeral' END AS ports,
      '/data:bind:' || CASE WHEN k % 2 = 0 THEN 'false' ELSE 'true' END || ',/scratch:tmpfs:false' AS mounts FROM lc""",
)
def ports_and_mounts(t: Tables) -> DataFrame:
    rows = contexts(t)
    ports = F.transform(
        "context.ports",
        lambda p: F.concat(
            text(p["container_port"]), F.lit("/"), p["protocol"], F.lit("/"),
            F.concat_ws("-", p["binding_scope"], p["host_port_mode"]),
        ),
    )
    mounts = F.transform(
        "context.mounts", lambda m: F.concat_ws(":", m["destination"], m["type"], text(m["read_only"]))
    )
    return rows.select(
        "event_id", F.array_join(ports, ",").alias("ports"), F.array_join(mounts, ",").alias("mounts")
    )


@query("fn7_user_class", duck_prefix("lc") + " SELECT event_id, CASE k % 4 WHEN 0 THEN 'root' WHEN 1 THEN 'nonroot' END AS user_class FROM lc")
def user_class(t: Tables) -> DataFrame:
    return contexts(t).select("event_id", F.col("context.configured_user").alias("user_class"))


@query(
    "fn8_context_groups",
    duck_prefix("lc") + f""" SELECT network_mode, count(DISTINCT (k % 4, k % 7 > 0 AND k < 3, k % 7 = 0, k % 2, k % 3)) AS contexts,
      count(*) AS n FROM (SELECT *, {NETWORK_SQL} AS network_mode FROM lc) GROUP BY 1""",
)
def context_groups(t: Tables) -> DataFrame:
    """Distinct context hashes per network mode: equal deployments must hash equally."""
    rows = contexts(t)
    # Users 2 and 3 are both without a class, so hashes alone cannot tell them apart.
    hashed = rows.select("context.network_mode", context.context_hash("context").alias("h"))
    return hashed.groupBy("network_mode").agg(
        F.count_distinct("h").alias("contexts"), F.count(F.lit(1)).alias("n")
    )


@query(
    "fn12_secret_scan",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '$.a.Token' WHEN doc_id % 3 = 1 THEN '$.list[1]' END AS path,
      CASE WHEN doc_id % 3 = 0 THEN 'token' ELSE 'api_key' END AS marker FROM documents WHERE doc_id % 3 < 2""",
)
def secret_scan(t: Tables) -> DataFrame:
    """A document per text with a secret-like key, a secret-like string, or none."""
    n = F.col("doc_id")
    key = F.when(n % 3 == 0, '{"Token": 5}').otherwise('{"plain": "flag:<secret>"}')
    item = F.when(n % 3 == 1, "MY_API_KEY=1").otherwise("fine")
    body = F.concat(F.lit('{"a": '), key, F.lit(', "n": '), text(n), F.lit(', "list": [true, "'), item, F.lit('"]}'))
    return documents.secret_findings(t.raw("documents").select("doc_id", body.alias("body")), "body", "doc_id")


@query(
    "fn13_document_diff",
    """SELECT o_orderkey, '$.b.c' AS path, o_orderstatus AS left_value, upper(substr(o_orderpriority, 3, 1)) AS right_value FROM orders
      WHERE o_orderstatus <> upper(substr(o_orderpriority, 3, 1))
    UNION ALL SELECT o_orderkey, '$.probe.value', cast(o_custkey AS varchar), '7' FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey <> 7
    UNION ALL SELECT o_orderkey, '$.only', '1', NULL FROM orders WHERE o_orderkey % 5 = 0""",
)
def document_diff(t: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    status = F.when(n % 2 == 0, "ok").otherwise("unavailable")
    only = F.when(n % 5 == 0, '"only": 1, ').otherwise("")
    left = F.concat(
        F.lit("{"), only, F.lit('"b": {"c": "'), "o_orderstatus", F.lit('"}, "probe": {"status": "'), status,
        F.lit('", "reason": "x", "value": '), text(F.col("o_custkey")), F.lit("}}"),
    )
    right = F.concat(
        F.lit('{"b": {"c": "'), F.upper(F.substring("o_orderpriority", 3, 1)),
        F.lit('"}, "probe": {"status": "ok", "value": 7}}'),
    )
    orders = t.raw("orders")
    return documents.document_diff(
        orders.select("o_orderkey", left.alias("d")), orders.select("o_orderkey", right.alias("d")), "d", "o_orderkey"
    )


@query(
    "str2_dedupe",
    duck_prefix("ex") + " SELECT DISTINCT event_id, us FROM ex",
)
def dedupe(t: Tables) -> DataFrame:
    """A feed that was read again with an overlap: two copies of half the events."""
    rows = t.execs.select("event_id", "us")
    return rows.unionByName(rows.where("us % 2 = 0")).dropDuplicates(["event_id"])


@query(
    "str4_tumbling_counts",
    duck_prefix("ex") + """, x AS (SELECT *, us // 21600000000 * 21600000000 AS window_us,
        coalesce(nullif(trim(coalesce(nullif(executable, ''), process_name)), ''), '<unknown>') AS ptok,
        coalesce(nullif(trim(coalesce(nullif(parent_executable, ''), parent_name)), ''), '<unknown>') AS partok FROM ex)
      SELECT image_digest, window_us, family, token, count(*) AS n FROM (
        SELECT image_digest, window_us, 'process_name' AS family, coalesce(process_name, '<unknown>') AS token FROM x
        UNION ALL SELECT image_digest, window_us, 'executable', ptok FROM x
        UNION ALL SELECT image_digest, window_us, 'parent_child', partok || ' -> ' || ptok FROM x
        UNION ALL SELECT image_digest, window_us, 'user_uid', coalesce(cast(user_uid AS varchar), '<unknown>') FROM x) y
      GROUP BY ALL""",
)
def tumbling_counts(t: Tables) -> DataFrame:
    """Token counts of six-hour windows over the whole table, the four families of executions."""
    width = 21_600_000_000
    rows = t.execs.withColumn("window_us", F.expr(f"us - pmod(us, {width})"))
    return exec_tokens(rows, ["image_digest", "window_us"])
