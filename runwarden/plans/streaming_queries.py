"""Queries that run as streams over the events and are checked like batch queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.operators import enrich
from runwarden.operators.profile import SHELL_FAMILY
from runwarden.plans.behaviour_queries import INTERVAL, TOKENS, WINDOWS, behaviour, r9
from runwarden.plans.enrich_queries import FOLD, LOOKBACK, PARENT_SQL, STATUS_FOLD
from runwarden.plans.ingest_queries import HOST, LINES_SQL, RULE, SENSOR, sensor_lines
from runwarden.plans.registry import ORACLE, query
from runwarden.plans.views import CUT_US, DAY_US, END_US, Tables, duck_prefix
from runwarden.session import ensure_checkpoint_dir, materialize
from runwarden.sources import readers, sinks
from runwarden.sources.line_source import SensorLineSource
from runwarden.streaming import parent_links, pipelines, window_log


def folder(t: Tables) -> str:
    """A fresh folder of one stream run, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"


def one_batch_each(t: Tables, events: DataFrame, slot: F.Column, parts: int, where: str) -> DataFrame:
    """Events as a stream of ``parts`` batches, those whose ``slot`` is 0 first.

    A batch is as many files as the table has splits, or the cluster cores, so no task writes or reads
    a whole batch; empty files make up for splits without rows, which write none.
    """
    folder, count = f"{where}/in", 0
    for part in range(parts):
        chosen = t.spread(events.where(slot == part))
        count = max(count, chosen.rdd.getNumPartitions())
        chosen.write.mode("append").parquet(folder)
        # Slices differ in their splits only by filters, so count is the same for all of them.
        missing = count * (part + 1) - len(sinks.matching(t.spark, f"{folder}/part-*"))
        if missing:
            empty = t.spark.createDataFrame([], events.schema).repartition(1)
            for _ in range(missing):
                empty.write.mode("append").parquet(folder)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", count).parquet(folder)


def slices(t: Tables, where: str, parts: int = 3) -> DataFrame:
    """The events as a stream of several batches, oldest first."""
    days = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - CUT_US) / (10 * DAY_US)) + 2
    slot = F.greatest(F.least(days, F.lit(parts - 1)), F.lit(0))
    return one_batch_each(t, t.raw("events"), slot, parts, where)


def _normalise(t: Tables, where: str) -> None:
    """Write the lines as a sensor would, then stream them into the two tables."""
    lines = sensor_lines(t).select("raw")
    lines.repartition(4).write.text(f"{where}/in")
    stream = readers.stream_sensor_lines(t.spark, f"{where}/in", files_per_batch=2)
    pipelines.normalise_stream(
        stream, SENSOR, RULE, HOST, f"{where}/events", f"{where}/letters", f"{where}/ck"
    ).awaitTermination()


@query(
    "str1_normalise_stream",
    duck_prefix("ex") + "," + LINES_SQL + """ SELECT event_id, us, n AS event_number, reported_container_id, process_name, executable,
      user_uid, process_ppid FROM nev""",
)
def normalise_stream(t: Tables) -> DataFrame:
    where = folder(t)
    _normalise(t, where)
    names = ["event_number", "reported_container_id", "process_name", "executable", "user_uid", "process_ppid"]
    events = pipelines.stored(t.spark, f"{where}/events", "event_id").read()
    return events.select("event_id", F.unix_micros("occurred_at").alias("us"), *names)


@query(
    "str9_dead_letter_stream",
    duck_prefix("ex") + "," + LINES_SQL + """ SELECT CASE outcome WHEN 'malformed' THEN 'JSONDecodeError' ELSE 'ValueError' END AS error_class,
      count(*) AS letters, count(*) AS kinds FROM cls WHERE outcome IN ('malformed', 'error') GROUP BY 1""",
)
def dead_letter_stream(t: Tables) -> DataFrame:
    where = folder(t)
    _normalise(t, where)
    stored = pipelines.stored(t.spark, f"{where}/letters", "letter_id").read()
    kinds = F.count_distinct("letter_id").alias("kinds")
    return stored.groupBy("error_class").agg(F.count(F.lit(1)).alias("letters"), kinds)


@query(
    "src1_read_sensor_jsonl",
    duck_prefix("ex") + "," + LINES_SQL + """ SELECT CASE WHEN NOT broken THEN n END AS event_number,
      CASE WHEN NOT broken THEN coalesce(process_name, '<NA>') END AS process_name,
      CASE WHEN NOT broken THEN command_line END AS command_line FROM ln""",
)
def read_sensor_jsonl(t: Tables) -> DataFrame:
    """All lines through the resumable source in two runs; the second one starts where the first one ended."""
    where = folder(t)
    t.spark.dataSource.register(SensorLineSource)
    # The source reads mounted files.
    mounted = where.removeprefix("file://").removeprefix("file:")
    rows = sensor_lines(t)
    for part in range(2):
        rows.where(F.col("n") % 2 == part).select("raw").repartition(2).write.mode("append").text(f"{where}/in")
        lines = t.spark.readStream.format("sensor_lines").option("path", f"{mounted}/in/part-*").load()
        writer = lines.writeStream.format("parquet").option("path", f"{where}/lines").option("checkpointLocation", f"{where}/ck")
        run = writer.start()
        run.processAllAvailable()
        run.stop()
    parsed = t.spark.read.schema("raw string").parquet(f"{where}/lines").select(F.try_parse_json("raw").alias("v"))
    field = lambda name: F.try_variant_get("v", f"$.output_fields['{name}']", "string")
    return parsed.select(
        field("evt.num").cast("bigint").alias("event_number"), field("proc.name").alias("process_name"),
        field("proc.cmdline").alias("command_line"),
    )


@query(
    "src3_read_trials",
    duck_prefix("trial") + """ SELECT trial_id, workload_id, 'img@sha256:' || image_digest AS reference, attack_like, u % 4 = 0 AS privileged
      FROM trial WHERE status = 'completed'""",
)
def read_trials(t: Tables) -> DataFrame:
    """Trial records written as JSON lines and read back."""
    where = folder(t)
    records = t.trials.select(
        "trial_id",
        "workload_id",
        "status",
        F.struct(F.concat(F.lit("img@sha256:"), "image_digest").alias("reference")).alias("image"),
        F.struct((F.col("u") % 4 == 0).alias("privileged")).alias("runtime_context"),
        F.struct("attack_like").alias("ground_truth"),
    )
    records.write.json(f"{where}/trials")
    out = readers.trials(t.spark, f"{where}/trials", one_per_file=False)
    return out.select(
        "trial_id", "workload_id", "image.reference", "ground_truth.attack_like", "runtime_context.privileged"
    )


@query(
    "snk2_write_summary",
    duck_prefix("ex") + """ SELECT container_id, cast(count(*) AS varchar) AS n, cast(count(DISTINCT process_name) AS varchar) AS names
      FROM ex GROUP BY 1""",
)
def write_summary(t: Tables) -> DataFrame:
    """A summary written as sorted CSV and as JSON lines; both are read back and must agree."""
    where = folder(t)
    rows = materialize(
        t.execs.groupBy("container_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("process_name").alias("names"))
    )
    columns = ["container_id", "n", "names"]
    sinks.write_summary(rows, f"{where}/csv", columns, ["container_id"])
    sinks.write_summary(rows, f"{where}/json", columns, ["container_id"], kind="json")
    table = t.spark.read.option("header", True).csv(f"{where}/csv")
    lines = t.spark.read.schema("container_id string, n string, names string").json(f"{where}/json")
    return table.intersectAll(lines)


@query(
    "snk3_integrity_manifest",
    duck_prefix("ex") + """, p AS (SELECT u % 48 AS part, count(*) AS n FROM ex GROUP BY ALL)
      SELECT part, problem, n FROM p, LATERAL (SELECT unnest([CASE part % 4 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'unrecorded' END,
        CASE WHEN part % 5 = 0 THEN 'missing' END]) AS problem) WHERE problem IS NOT NULL""",
)
def integrity_manifest(t: Tables) -> DataFrame:
    """Executions in a file for each group of users, against a manifest in which every fourth file has another
    hash, every fourth is forgotten and every fifth group has a file more; with the rows of the group."""
    where = folder(t)
    rows = t.execs.select("event_id", "us", (F.col("u") % 48).alias("part"))
    rows.repartition(16, "part").write.partitionBy("part").parquet(f"{where}/table")
    current = sinks.file_hashes(t.spark, f"{where}/table").where("path LIKE '%.parquet'")
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint")
    kept = current.where(part % 4 != 1).withColumn("sha256", F.when(part % 4 == 0, F.lit("0")).otherwise(F.col("sha256")))
    more = current.where(part % 5 == 0).withColumn("path", F.concat("path", F.lit(".old")))
    problems = sinks.verify_manifest(current, kept.unionByName(more)).select(part.alias("part"), "problem")
    sizes = t.spark.read.parquet(f"{where}/table").groupBy(F.col("part").cast("bigint").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return problems.join(sizes, "part")


def late_slices(t: Tables, where: str) -> DataFrame:
    """As ``slices``, but a third of the events, over all times, arrives with the last one."""
    events, arrival = t.raw("events"), F.expr(_arrival("unix_micros(cast(ts AS timestamp))", "div"))
    return one_batch_each(t, events, arrival, 3, where)


def _arrival(us: str, div: str) -> str:
    """Batch of an event: a third comes last, the rest by time."""
    return f"CASE WHEN event_id % 3 = 0 THEN 2 ELSE greatest(least(({us} - {CUT_US}) {div} {10 * DAY_US} + 2, 1), 0) END"


def _stored(t: Tables, twice: bool = False) -> window_log.WindowLog:
    """All executions and lifecycle events streamed into a log of daily windows."""
    where = folder(t)
    base = t.base_of(late_slices(t, where))
    rows = window_log.feed(t.execs_of(base), t.lifecycle_of(base))
    if twice:
        rows = rows.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    log = window_log.WindowLog(t.spark, f"{where}/log", DAY_US)
    window_log.window_stream(rows, log, f"{where}/ck").awaitTermination()
    return log


@query("str2_dedupe_stream", duck_prefix("ex") + " SELECT DISTINCT event_id, us FROM ex")
def dedupe_stream(t: Tables) -> DataFrame:
    """Every event twice in the stream and a third of them late, each once in the result."""
    return _stored(t, twice=True).events().where("is_exec").select("event_id", F.unix_micros("occurred_at").alias("us"))


@query(
    "str3_late_rows",
    f"""WITH ev AS (SELECT event_type IN ('click', 'view', 'error') AS is_exec, epoch_us(ts) AS us,
        {_arrival("epoch_us(ts)", "//")} AS arrival FROM events WHERE event_type IN ('click', 'view', 'error', 'signup', 'purchase')),
      reached AS (SELECT x.arrival, max(y.us) AS us FROM (SELECT DISTINCT arrival FROM ev) x JOIN ev y ON y.arrival < x.arrival GROUP BY 1)
      SELECT is_exec, ev.us // {DAY_US} AS w, count(*) FILTER ((ev.us // {DAY_US} + 1) * {DAY_US} <= reached.us) AS late, count(*) AS n
      FROM ev LEFT JOIN reached USING (arrival) GROUP BY ALL""",
)
def late_rows(t: Tables) -> DataFrame:
    """All rows of every window, and how many came after a later window had its first revision."""
    counts = F.count_if("late").alias("late"), F.count(F.lit(1)).alias("n")
    return _stored(t).events().groupBy("is_exec", "w").agg(*counts)


_EVERY_WINDOW = WINDOWS[: WINDOWS.index("exw AS")] + f"""
exw AS (SELECT *, us // {DAY_US} AS w,
  coalesce(nullif(trim(coalesce(nullif(executable, ''), process_name)), ''), '<unknown>') AS ptok,
  coalesce(nullif(trim(coalesce(nullif(parent_executable, ''), parent_name)), ''), '<unknown>') AS partok FROM ex),
lcw AS (SELECT *, us // {DAY_US} AS w FROM lc)"""


@query(
    "str4_tumbling_stream",
    ",".join([duck_prefix("ex", "lc"), _EVERY_WINDOW, TOKENS.replace("greatest(w, -1)", "w")])
    + " SELECT image_digest, w, family, token, n FROM cnt",
)
def tumbling_stream(t: Tables) -> DataFrame:
    """Counts of all families in all windows, the newest and the late rows included."""
    return _stored(t).counts().where(F.col("family") != SHELL_FAMILY)


@query("str5_score_stream", ORACLE["sco5_anomaly_score"])
def score_stream(t: Tables) -> DataFrame:
    """All days after training scored while the stream runs, with a third of the events late."""
    where = folder(t)
    trained = behaviour(t)
    base = t.base_of(late_slices(t, where))
    rows = window_log.feed(t.execs_of(base), t.lifecycle_of(base))
    rows = rows.where((F.unix_micros("occurred_at") >= CUT_US) & (F.unix_micros("occurred_at") < END_US))
    log = window_log.WindowLog(t.spark, f"{where}/log", DAY_US, CUT_US)
    window_log.score_stream(rows, log, trained.baseline, trained.numeric_summary, f"{where}/ck", 1).awaitTermination()
    log.finish(0, INTERVAL.scoring_windows, trained.baseline, trained.numeric_summary, 1)
    names = ["total_score", "categorical_distance", "novelty_score", "numeric_deviation"]
    return log.scores().select(
        "image_digest", "w", "exec_count", "lifecycle_count", "status", "score_band", *[r9(n) for n in names]
    )


@query(
    "str6_parent_stream",
    duck_prefix("ex") + "," + PARENT_SQL + """ SELECT event_id, parent_event_id FROM ex LEFT JOIN par USING (event_id) WHERE process_ppid > 0""",
)
def parent_stream(t: Tables) -> DataFrame:
    """Links of a stream in which a third of the events comes last."""
    where = folder(t)
    execs = t.execs_of(t.base_of(late_slices(t, where)))
    parent_links.parent_stream(execs, f"{where}/links", f"{where}/ck", LOOKBACK, "40 days").awaitTermination()
    return parent_links.latest_links(t.spark.read.parquet(f"{where}/links"))


@query(
    "str7_shell_then_tool_stream",
    duck_prefix("ex") + f""" SELECT a.container_id, a.event_id AS shell_event_id, b.event_id AS tool_event_id
      FROM ex a JOIN ex b ON a.container_id = b.container_id AND b.us >= a.us AND b.us <= a.us + {DAY_US}
      WHERE a.process_name = 'sh' AND b.process_name = 'click'""",
)
def shell_then_tool_stream(t: Tables) -> DataFrame:
    """A third of the events, shells and tools of all times, arrives with the last batch."""
    where = folder(t)
    execs = t.execs_of(t.base_of(late_slices(t, where)))
    shells, tools = execs.where("process_name = 'sh'"), execs.where("process_name = 'click'")
    places = f"{where}/seen", f"{where}/pairs", f"{where}/ck"
    pipelines.shell_then_tool_stream(shells, tools, *places, DAY_US // 1_000_000).awaitTermination()
    return pipelines.shell_tool_pairs(t.spark, f"{where}/pairs")


@query(
    "str8_identity_stream",
    duck_prefix("lc") + f""" SELECT docker_host_id, container_id, {FOLD.format('container_name')},
      {FOLD.format('image_id')}, {FOLD.format('image_ref')}, {FOLD.format('image_digest')}, {STATUS_FOLD}
    FROM (SELECT *, least(us, received_us) AS s FROM lc) GROUP BY ALL""",
)
def identity_stream(t: Tables) -> DataFrame:
    where, parts = folder(t), 3
    lifecycle = t.lifecycle_of(t.base_of(slices(t, where, parts)))
    pipelines.identity_stream(lifecycle, f"{where}/state", f"{where}/ck").awaitTermination()
    out = enrich.identity_view(pipelines.identity_table(t.spark, f"{where}/state").read())
    return out.withColumns({c: F.unix_micros(c) for c, kind in out.dtypes if kind == "timestamp"})


@query(
    "str10_new_alerts",
    """SELECT DISTINCT 'i' || user_id AS incident_id FROM events WHERE event_type IN ('error', 'purchase')""",
)
def alert_stream(t: Tables) -> DataFrame:
    """Users stand for incidents: errors are critical, purchases high, the rest low."""
    where = folder(t)
    kind = F.col("event_type")
    level = F.when(kind == "error", "critical").when(kind == "purchase", "high").otherwise("low")
    opened = slices(t, where).select(
        F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("incident_id"),
        F.lit("open").alias("status"),
        level.alias("severity_level"),
    )
    pipelines.alert_stream(opened, f"{where}/told", "high", f"{where}/ck").awaitTermination()
    return pipelines.stored(t.spark, f"{where}/told", "incident_id").read().select("incident_id")
