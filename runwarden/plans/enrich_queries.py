"""Queries for identity, parents, chains, folds, pages and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.operators import enrich
from runwarden.plans.behaviour_queries import WINDOWS
from runwarden.plans.registry import query
from runwarden.plans.views import CUT_US, DAY_US, START_US, Tables, duck_prefix

LOOKBACK = 10 * 86_400

REPORTED_SQL = """rep AS (SELECT *, CASE k % 25 WHEN 0 THEN substr(container_id, 1, 1) WHEN 1 THEN 'host'
    WHEN 2 THEN NULL WHEN 3 THEN container_id WHEN 4 THEN substr(container_id, 1, 2)
    WHEN 5 THEN substr(container_id, 1, 3) ELSE substr(container_id, 1, 12) END AS rid,
    CASE WHEN k % 4 = 0 THEN NULL ELSE docker_host_id END AS rhost FROM ex),
  inv AS (SELECT DISTINCT container_id, docker_host_id, u, g FROM ex),
  hit AS (SELECT r.event_id, count(*) AS c, min(i.container_id) AS cid, min(i.docker_host_id) AS host,
      min(i.u) AS u, min(i.g) AS g
    FROM rep r JOIN inv i ON rid IS NOT NULL AND rid <> 'host' AND starts_with(i.container_id, rid)
      AND (rhost IS NULL OR rhost = i.docker_host_id) GROUP BY ALL)"""


def reported(t: Tables) -> DataFrame:
    """Executions as a sensor reports them: short, missing or ambiguous container ids."""
    k = F.col("k") % 25
    rid = (
        F.when(k == 0, F.substring("container_id", 1, 1))
        .when(k == 1, F.lit("host"))
        .when(k == 2, F.lit(None).cast("string"))
        .when(k == 3, F.col("container_id"))
        .when(k == 4, F.substring("container_id", 1, 2))
        .when(k == 5, F.substring("container_id", 1, 3))
        .otherwise(F.substring("container_id", 1, 12))
    )
    host = F.when(F.col("k") % 4 != 0, F.col("docker_host_id"))
    return t.execs.select(
        "event_id",
        rid.alias("reported_container_id"),
        host.alias("reported_docker_host_id"),
        F.lit("reported").alias("reported_container_name"),
        F.concat(F.lit("ref"), F.col("k").cast("string")).alias("reported_image_ref"),
    )


def inventory(t: Tables) -> DataFrame:
    return t.execs.select(
        "container_id",
        "docker_host_id",
        F.concat(F.lit("name-"), F.col("u").cast("string")).alias("container_name"),
        F.concat(F.lit("iid"), F.col("g").cast("string")).alias("image_id"),
        F.concat(F.lit("repo/app"), F.col("g").cast("string")).alias("image_ref"),
        "image_digest",
    ).distinct()


@query(
    "jn1_resolve_container",
    duck_prefix("ex") + "," + REPORTED_SQL + """ SELECT event_id, CASE WHEN c = 1 THEN 'resolved'
      WHEN c > 1 THEN 'ambiguous' ELSE 'unresolved' END AS correlation_status,
      CASE WHEN c = 1 THEN cid END AS container_id
    FROM rep LEFT JOIN hit USING (event_id)""",
)
def resolve_container(t: Tables) -> DataFrame:
    out = enrich.resolve_container(reported(t), inventory(t))
    return out.select("event_id", "correlation_status", "identity.container_id")


@query(
    "jn2_apply_identity",
    duck_prefix("ex") + "," + REPORTED_SQL + """ SELECT event_id, CASE WHEN c = 1 THEN host ELSE rhost END AS docker_host_id,
      CASE WHEN c = 1 THEN cid ELSE rid END AS container_id,
      CASE WHEN c = 1 THEN 'name-' || hit.u ELSE 'reported' END AS container_name,
      CASE WHEN c = 1 THEN 'repo/app' || hit.g ELSE 'ref' || k END AS image_ref,
      CASE WHEN c = 1 THEN 'iid' || hit.g END AS image_id, CASE WHEN c = 1 THEN 'img' || hit.g END AS image_digest
    FROM rep LEFT JOIN hit USING (event_id)""",
)
def apply_identity(t: Tables) -> DataFrame:
    out = enrich.apply_identity(enrich.resolve_container(reported(t), inventory(t)))
    names = ["docker_host_id", "container_id", "container_name", "image_ref", "image_id", "image_digest"]
    return out.select("event_id", *names)


# Some probes know only the host, only the container, or neither.
SCOPED_SQL = """sc AS (SELECT event_id, time_nano, us, process_pid AS pid, process_ppid AS ppid,
    CASE WHEN k % 9 IN (1, 3) THEN NULL ELSE docker_host_id END AS h,
    CASE WHEN k % 9 IN (2, 3) THEN NULL ELSE container_id END AS c, sensor_instance_id AS s FROM ex),
  par AS (SELECT p.event_id, arg_max(q.event_id, (q.time_nano, q.event_id)) AS parent_event_id
    FROM sc p JOIN sc q ON q.pid = p.ppid AND q.time_nano <= p.time_nano AND q.us >= p.us - {lookback}
      AND q.event_id <> p.event_id
      AND (p.h IS NULL OR q.h = p.h) AND (p.c IS NULL OR q.c = p.c)
      AND (p.h IS NOT NULL OR p.c IS NOT NULL OR q.s = p.s)
    WHERE p.ppid > 0 GROUP BY ALL)""".replace("{lookback}", str(LOOKBACK * 1_000_000))


@query(
    "jn3_correlate_parent",
    duck_prefix("ex") + "," + SCOPED_SQL + """ SELECT event_id, parent_event_id FROM sc
      LEFT JOIN par USING (event_id) WHERE ppid > 0""",
)
def correlate_parent(t: Tables) -> DataFrame:
    k = F.col("k") % 9
    execs = t.execs.withColumn(
        "docker_host_id", F.when(~k.isin(1, 3), F.col("docker_host_id"))
    ).withColumn("container_id", F.when(~k.isin(2, 3), F.col("container_id")))
    return enrich.correlate_parent(execs, LOOKBACK)


PARENT_SQL = f"""par AS (SELECT p.event_id, arg_max(q.event_id, (q.time_nano, q.event_id)) AS parent_event_id
    FROM ex p JOIN ex q ON q.process_pid = p.process_ppid AND q.time_nano <= p.time_nano
      AND q.us >= p.us - {LOOKBACK * 1_000_000} AND q.event_id <> p.event_id
      AND q.docker_host_id = p.docker_host_id AND q.container_id = p.container_id
    WHERE p.process_ppid > 0 GROUP BY ALL)"""

CHAIN_SQL = PARENT_SQL + """, linked AS (SELECT ex.*, parent_event_id FROM ex LEFT JOIN par USING (event_id)),
  walk AS (SELECT event_id, parent_event_id AS node, 1 AS depth FROM linked WHERE parent_event_id IS NOT NULL
    UNION ALL SELECT w.event_id, l.parent_event_id, w.depth + 1 FROM walk w JOIN linked l ON l.event_id = w.node
    WHERE l.parent_event_id IS NOT NULL )"""


def recursive(prefix: str) -> str:
    return prefix.replace("WITH ", "WITH RECURSIVE ", 1)


def linked(t: Tables) -> DataFrame:
    return enrich.with_parent(t.execs, LOOKBACK)


@query(
    "jn4_ancestor_chain",
    recursive(duck_prefix("ex")) + "," + CHAIN_SQL + """ SELECT event_id, depth, node AS ancestor_id FROM walk""",
)
def ancestor_chain(t: Tables) -> DataFrame:
    chains = enrich.ancestor_chain(linked(t))
    rows = chains.select("event_id", F.posexplode("ancestors"))
    return rows.select(
        "event_id", (F.col("pos") + 1).alias("depth"), F.col("col.event_id").alias("ancestor_id")
    )


@query(
    "jn5_process_chain",
    recursive(duck_prefix("ex")) + "," + CHAIN_SQL + """, nodes AS (SELECT event_id, 0 AS depth, event_id AS node FROM ex
        UNION ALL SELECT event_id, depth, node FROM walk)
      SELECT event_id, count(*) AS length, string_agg(node, '>' ORDER BY depth) AS path FROM nodes GROUP BY 1""",
)
def process_chain(t: Tables) -> DataFrame:
    chains = enrich.process_chain(linked(t))
    ids = F.transform("process_chain", lambda n: n.getField("event_id"))
    return chains.select(
        "event_id",
        F.size("process_chain").cast("bigint").alias("length"),
        F.array_join(ids, ">").alias("path"),
    )


@query(
    "jn6_interval_join",
    duck_prefix("ex") + f""" SELECT a.event_id AS shell_event_id, b.event_id AS tool_event_id,
      round((b.us - a.us) / 1e6, 6) AS elapsed_seconds
    FROM ex a JOIN ex b ON a.container_id = b.container_id AND b.us >= a.us AND b.us <= a.us + {DAY_US}
    WHERE a.process_name = 'sh' AND b.process_name = 'click'""",
)
def interval_join(t: Tables) -> DataFrame:
    shells = t.execs.where("process_name = 'sh'").select(
        "container_id", F.col("event_id").alias("shell_event_id"), F.col("us").alias("shell_us")
    )
    tools = t.execs.where("process_name = 'click'").select(
        "container_id", F.col("event_id").alias("tool_event_id"), F.col("us").alias("tool_us")
    )
    pairs = enrich.within_seconds_after(shells, tools, ["container_id"], 86_400, "shell_us", "tool_us")
    elapsed = F.round((F.col("tool_us") - F.col("shell_us")) / 1e6, 6)
    return pairs.select("shell_event_id", "tool_event_id", elapsed.alias("elapsed_seconds"))


PROFILE_SQL = f"""prof AS (SELECT 'P' || c_custkey AS profile_id, 'img' || (c_custkey % 8) AS image_digest,
    c_acctbal > 0 AS passed, CASE WHEN c_custkey % 3 <> 0 THEN {START_US} + c_custkey * 1000000 END AS activated_at,
    {START_US} + (c_custkey % 5) * {DAY_US} AS t0, {START_US} + (c_custkey % 5 + 4) * {DAY_US} AS t1 FROM customer),
  act AS (SELECT *, CASE WHEN activated_at IS NOT NULL AND passed THEN activated_at END AS act_at FROM prof),
  st AS (SELECT *, CASE WHEN act_at IS NOT NULL THEN lead(act_at) OVER (PARTITION BY image_digest
      ORDER BY act_at NULLS LAST, profile_id) END AS retired_at FROM act),
  status AS (SELECT *, CASE WHEN act_at IS NULL THEN 'draft' WHEN retired_at IS NULL THEN 'active'
      ELSE 'retired' END AS status FROM st)"""


def profiles(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.raw("customer").select(
        F.concat(F.lit("P"), key.cast("string")).alias("profile_id"),
        F.concat(F.lit("img"), (key % 8).cast("string")).alias("image_digest"),
        (F.col("c_acctbal") > 0).alias("passed"),
        F.when(key % 3 != 0, F.lit(START_US) + key * 1_000_000).alias("activated_at"),
        (F.lit(START_US) + (key % 5) * F.lit(DAY_US)).alias("training_start_us"),
        (F.lit(START_US) + (key % 5 + 4) * F.lit(DAY_US)).alias("training_end_us"),
    )


@query(
    "win5_active_profile",
    "WITH " + PROFILE_SQL + " SELECT profile_id, image_digest, status, retired_at FROM status",
)
def active_profile(t: Tables) -> DataFrame:
    return enrich.active_profiles(profiles(t)).select("profile_id", "image_digest", "status", "retired_at")


@query(
    "jn8_profile_for_window",
    "WITH " + PROFILE_SQL + f""", win AS (SELECT 'w' || o_orderkey AS window_id, 'img' || (o_orderkey % 8) AS image_digest,
        {START_US} + (o_orderkey % 20) * {DAY_US} AS s, {START_US} + (o_orderkey % 20 + 1) * {DAY_US} AS e,
        CASE WHEN o_orderkey % 2 = 0 THEN 'P' || o_custkey END AS pid FROM orders)
      SELECT window_id, win.image_digest, status.profile_id FROM win JOIN status USING (image_digest)
      WHERE (CASE WHEN pid IS NULL THEN status = 'active'
             ELSE pid = status.profile_id AND passed AND status <> 'draft' END)
        AND NOT (s < t1 AND e > t0)""",
)
def profile_for_window(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    windows = t.raw("orders").select(
        F.concat(F.lit("w"), key.cast("string")).alias("window_id"),
        F.concat(F.lit("img"), (key % 8).cast("string")).alias("image_digest"),
        (F.lit(START_US) + (key % 20) * F.lit(DAY_US)).alias("start_us"),
        (F.lit(START_US) + (key % 20 + 1) * F.lit(DAY_US)).alias("end_us"),
        F.when(key % 2 == 0, F.concat(F.lit("P"), F.col("o_custkey").cast("string"))).alias("profile_id"),
    )
    return enrich.profile_for_window(windows, enrich.active_profiles(profiles(t)))


@query(
    "win4_profile_version",
    """WITH b AS (SELECT 'img' || (o_orderkey % 8) AS image_digest, 'P' || o_orderkey AS profile_id,
        sha256(o_orderstatus || (o_custkey % 50)) AS model_hash, epoch_us(o_orderdate) AS created_at FROM orders),
      f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY image_digest, model_hash
        ORDER BY created_at, profile_id) = 1)
    SELECT *, row_number() OVER (PARTITION BY image_digest ORDER BY created_at, profile_id)
      AS profile_version FROM f""",
)
def profile_version(t: Tables) -> DataFrame:
    builds = t.raw("orders").select(
        F.concat(F.lit("img"), (F.col("o_orderkey") % 8).cast("string")).alias("image_digest"),
        F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("profile_id"),
        F.sha2(F.concat("o_orderstatus", (F.col("o_custkey") % 50).cast("string")), 256).alias("model_hash"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
    )
    out = enrich.number_versions(builds)
    return out.withColumn("profile_version", F.col("profile_version").cast("bigint"))


FOLD = """arg_max({0}, (s, {0})) FILTER ({0} IS NOT NULL) AS {0}"""
STATUS_FOLD = """coalesce(arg_max(image_digest_status, (s, image_digest_status))
  FILTER (image_digest_status <> 'inspection_failed'), max(image_digest_status)) AS image_digest_status,
  min(s) AS first_seen_at, max(s) AS last_seen_at"""


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c, kind in df.dtypes if kind == "timestamp"})


@query(
    "win1_image_identity",
    duck_prefix("lc") + f""" SELECT docker_host_id, image_id, {FOLD.format('image_ref')},
      {FOLD.format('image_digest')}, {STATUS_FOLD}
    FROM (SELECT *, least(us, received_us) AS s FROM lc) GROUP BY ALL""",
)
def image_identity(t: Tables) -> DataFrame:
    return _micros(enrich.image_identities(t.lifecycle))


@query(
    "win2_container_identity",
    duck_prefix("lc") + f""" SELECT docker_host_id, container_id, {FOLD.format('container_name')},
      {FOLD.format('image_id')}, {FOLD.format('image_ref')}, {FOLD.format('image_digest')},
      {FOLD.format('snapshot')}, {STATUS_FOLD}
    FROM (SELECT *, CASE WHEN k % 8 < 3 THEN 'snap' || k END AS snapshot, least(us, received_us) AS s FROM lc)
    GROUP BY ALL""",
)
def container_identity(t: Tables) -> DataFrame:
    snapshot = F.when(F.col("k") % 8 < 3, F.concat(F.lit("snap"), F.col("k").cast("string")))
    rows = t.lifecycle.withColumn("snapshot", snapshot)
    return _micros(enrich.container_identities(rows, "snapshot"))


@query(
    "win3_heartbeats",
    f"""SELECT event_type AS service_name, 'i' || (user_id % 10) AS instance_id,
      arg_max('st' || (event_id % 4), event_id) AS status,
      arg_min(least(epoch_us(ts) + (event_id % 7) * 1000000, {CUT_US}), event_id) AS first_seen_at,
      max(least(epoch_us(ts) + (event_id % 7) * 1000000, {CUT_US})) AS last_seen_at FROM events GROUP BY ALL""",
)
def heartbeats(t: Tables) -> DataFrame:
    observed = F.timestamp_micros(
        F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 7) * 1_000_000
    )
    beats = t.raw("events").select(
        F.col("event_type").alias("service_name"),
        F.concat(F.lit("i"), (F.col("user_id") % 10).cast("string")).alias("instance_id"),
        F.concat(F.lit("st"), (F.col("event_id") % 4).cast("string")).alias("status"),
        F.col("event_id").alias("arrival"),
        observed.alias("observed_at"),
    )
    return _micros(enrich.fold_heartbeats(beats, F.timestamp_micros(F.lit(CUT_US))))


@query(
    "nrm20_predicate_scan",
    duck_prefix("ex") + f""" SELECT event_id, container_id, time_nano FROM ex WHERE image_digest = 'img3'
      AND process_name = 'click' AND starts_with(executable, '/usr/bin/click-9') AND user_uid >= 1
      AND time_nano < {CUT_US * 1000}""",
)
def predicate_scan(t: Tables) -> DataFrame:
    out = enrich.filter_events(
        t.execs,
        equals={"image_digest": "img3", "process_name": "click", "container_id": None},
        prefixes={"executable": "/usr/bin/click-9"},
        minimums={"user_uid": 1},
        before={"time_nano": CUT_US * 1000},
    )
    return out.select("event_id", "container_id", "time_nano")


@query(
    "srt1_keyset_page",
    duck_prefix("ex") + f""" SELECT event_id, time_nano FROM ex WHERE time_nano < {CUT_US * 1000}
      OR (time_nano = {CUT_US * 1000} AND event_id > 'e5') ORDER BY time_nano DESC, event_id LIMIT 100""",
)
def keyset_page(t: Tables) -> DataFrame:
    return enrich.keyset_page(t.execs.select("event_id", "time_nano"), 100, (CUT_US * 1000, "e5"))


@query(
    "srt2_top_k_per_container",
    duck_prefix("ex") + """ SELECT container_id, event_id, row_number() OVER (PARTITION BY container_id
      ORDER BY us DESC, event_id) AS rank FROM ex QUALIFY rank <= 15""",
)
def top_k(t: Tables) -> DataFrame:
    rows = t.execs.select("container_id", "event_id", "us")
    top = enrich.top_per_group(rows, ["container_id"], [F.desc("us"), F.asc("event_id")], 15)
    return top.select("container_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "set1_union_timeline",
    duck_prefix("ex", "lc") + """ SELECT event_id, us, 'process' AS source FROM ex
      UNION ALL SELECT event_id, us, 'runtime' FROM lc""",
)
def union_timeline(t: Tables) -> DataFrame:
    execs = t.execs.select("event_id", "us", F.lit("process").alias("source"))
    return execs.unionByName(t.lifecycle.select("event_id", "us", F.lit("runtime").alias("source")))


_SUPPORT = """ SELECT coalesce(b.image_digest, o.image_digest) AS image_digest,
      coalesce(b.ptok, o.ptok) AS token, b.ptok IS NOT NULL AS in_baseline, o.ptok IS NOT NULL AS in_observed
    FROM (SELECT DISTINCT image_digest, ptok FROM exw WHERE w < 0) b
    FULL JOIN (SELECT DISTINCT image_digest, ptok FROM exw WHERE w >= 0) o
      ON b.image_digest = o.image_digest AND b.ptok = o.ptok"""


@query("set2_support_union", duck_prefix("ex", "lc") + "," + WINDOWS + _SUPPORT)
def support_union(t: Tables) -> DataFrame:
    from runwarden.operators.profile import process_token

    rows = t.execs.select("image_digest", process_token().alias("token"), F.col("us") < CUT_US)
    rows = rows.toDF("image_digest", "token", "training")
    return rows.groupBy("image_digest", "token").agg(
        F.bool_or("training").alias("in_baseline"), F.bool_or(~F.col("training")).alias("in_observed")
    )


@query(
    "set3_intersect",
    duck_prefix("ex", "lc") + " SELECT container_id FROM ex INTERSECT SELECT container_id FROM lc",
)
def intersect(t: Tables) -> DataFrame:
    return t.execs.select("container_id").intersect(t.lifecycle.select("container_id"))


@query(
    "set4_except",
    duck_prefix("ex") + """ SELECT container_id, k FROM ex WHERE et = 'click'
      EXCEPT SELECT container_id, k FROM ex WHERE et <> 'click'""",
)
def set_except(t: Tables) -> DataFrame:
    rows = t.execs.select("container_id", "k", "et")
    return rows.where("et = 'click'").drop("et").subtract(rows.where("et <> 'click'").drop("et"))
