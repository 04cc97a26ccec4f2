"""Queries for rules, allowlists, runs, incidents and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden import config
from runwarden.operators import custom_rules, enrich, incidents, rules
from runwarden.plans.behaviour_queries import (
    BAND,
    DISTANCES,
    NUMBERS,
    SCORES,
    TOKENS,
    behaviour,
    check,
    r9,
)
from runwarden.plans.detection import Detection
from runwarden.plans.enrich_queries import LOOKBACK, recursive
from runwarden.plans.registry import query
from runwarden.plans.views import CUT_US, DAY_US, Tables, duck_prefix

DAY = 86_400

# --- checking SQL ------------------------------------------------------------------------

IDENTITY = """
idn0 AS (SELECT *, trim(coalesce(executable, '')) AS path, trim(coalesce(process_name, '')) AS short,
    lower(regexp_extract(trim(coalesce(executable, '')), '([^/]*)/*$', 1)) AS bname,
    lower(regexp_extract(string_split_regex(trim(command_line), '\\s+')[2], '([^/]*)/*$', 1)) AS word2
  FROM exw),
idn1 AS (SELECT *, bname IN ('busybox', 'toybox') AS multi,
    coalesce(CASE WHEN lower(short) NOT IN ('', 'busybox', 'toybox') THEN lower(short) END,
      CASE WHEN word2 <> '' AND NOT starts_with(word2, '-') THEN word2 END,
      nullif(lower(short), '')) AS applet FROM idn0),
idn AS (SELECT *,
    CASE WHEN multi THEN coalesce(applet, bname) WHEN bname <> '' THEN bname ELSE lower(short) END AS program,
    CASE WHEN multi THEN coalesce(applet, path) ELSE coalesce(nullif(path, ''), nullif(short, ''), '<unknown>')
      END AS ppath,
    coalesce(nullif(trim(parent_executable), ''), nullif(trim(parent_name), '')) AS par_path,
    CASE WHEN multi OR path = '' THEN NULL ELSE path END AS lk_path,
    CASE WHEN multi THEN applet ELSE nullif(lower(short), '') END AS lk_name FROM idn1),
bx AS (SELECT DISTINCT image_digest, token FROM base_tok WHERE family = 'executable'),
bn AS (SELECT DISTINCT image_digest, lower(token) AS token FROM base_tok WHERE family = 'process_name'),
flagged AS (SELECT idn.*, bx.token IS NULL AND bn.token IS NULL AS unseen FROM idn
  LEFT JOIN bx ON bx.image_digest = idn.image_digest AND bx.token = lk_path
  LEFT JOIN bn ON bn.image_digest = idn.image_digest AND bn.token = lk_name WHERE w >= 0),
shells AS (SELECT * FROM flagged WHERE unseen AND program IN ('ash','bash','dash','fish','ksh','sh','zsh')),
tools AS (SELECT * FROM flagged WHERE unseen AND program <> ''
  AND program NOT IN ('ash','bash','dash','fish','ksh','sh','zsh'))"""

MATCHES = f"""
rw(rule_id, category, sev, conf, eligible) AS (VALUES ('DET-001', 'anomaly', 0.65, 0.7, false),
  ('DET-002', 'execution', 0.72, 0.9, true), ('DET-003', 'privilege', 0.78, 0.9, true),
  ('DET-004', 'execution', 0.64, 0.8, true), ('DET-005', 'correlation', 0.9, 0.95, true),
  ('DET-006', 'container-control', 0.35, 0.95, false),
  ('DET-007', 'container-configuration', 0.92, 0.95, true)),
pairs AS (SELECT a.image_digest, a.w, a.container_id, a.event_id AS shell_id, b.event_id AS tool_id, b.us,
    round((b.us - a.us) / 1e6, 6) AS elapsed
  FROM shells a JOIN tools b USING (image_digest, w, container_id)
  WHERE b.us >= a.us AND b.us <= a.us + {DAY_US}),
m0 AS (
  SELECT image_digest, w, 'DET-001' AS rule_id, {CUT_US} + (w + 1) * {DAY_US} AS us, 'anomaly_score' AS source_type,
    image_digest || ':' || w AS source_id, NULL AS container_id, NULL AS executable, NULL AS parent,
    NULL AS shell_id, NULL AS tool_id FROM sc WHERE exec_count > 0 AND round(total, 12) >= 0.5
  UNION ALL SELECT image_digest, w, 'DET-002', us, 'process_event', event_id, container_id, ppath, par_path,
    NULL, NULL FROM shells
  UNION ALL SELECT image_digest, w, 'DET-003', us, 'process_event', event_id, container_id, ppath, NULL, NULL, NULL
    FROM flagged WHERE user_uid = 0 AND image_digest NOT IN
      (SELECT image_digest FROM base_tok WHERE family = 'user_uid' AND token = '0')
  UNION ALL SELECT image_digest, w, 'DET-004', us, 'process_event', event_id, container_id, ppath, par_path,
    NULL, NULL FROM tools
  UNION ALL SELECT image_digest, w, 'DET-005', us, 'derived_correlation', shell_id || ':' || tool_id,
    container_id, NULL, NULL, shell_id, tool_id FROM pairs
  UNION ALL SELECT image_digest, w, 'DET-006', us, 'runtime_event', event_id, container_id, NULL, NULL, NULL, NULL
    FROM lcw WHERE w >= 0 AND event_type = 'container' AND action IN ('exec_create', 'exec_start', 'exec_die')
  UNION ALL SELECT image_digest, w, 'DET-007', us, 'runtime_event', event_id, container_id, NULL, NULL, NULL, NULL
    FROM lcw WHERE w >= 0 AND event_type = 'container' AND action IN ('create', 'start') AND privileged),
m1 AS (SELECT m0.*, category, sev, conf, eligible FROM m0 JOIN rw USING (rule_id)
  SEMI JOIN (SELECT image_digest, w FROM sc WHERE exec_count > 0) ok USING (image_digest, w))"""

ALLOW = f"""
al AS (SELECT 'a' || lpad(cast(s_suppkey AS varchar), 6, '0') AS allowlist_id,
    'img' || (s_suppkey % 8) AS image_digest, 'DET-00' || (2 + s_suppkey % 6) AS rule_id,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN '/bin/sh'
      ELSE '/usr/bin/click-' || (90 + s_nationkey % 10) END AS executable,
    CASE WHEN s_suppkey % 5 < 2 THEN '/sbin/p' || (s_nationkey % 5) END AS parent_executable,
    s_acctbal > 1000 AS active,
    CASE WHEN s_suppkey % 4 = 0 THEN {CUT_US} + (s_nationkey - 12) * {DAY_US} END AS expires_us FROM supplier),
live AS (SELECT * FROM al WHERE active AND (expires_us IS NULL OR expires_us > {CUT_US})),
dsup AS (SELECT m1.rule_id, m1.image_digest, m1.w, source_type, source_id, min(allowlist_id) AS by_id
  FROM m1 JOIN live l ON l.image_digest = m1.image_digest AND l.rule_id = m1.rule_id AND m1.rule_id <> 'DET-005'
    AND (l.executable IS NULL OR l.executable = m1.executable)
    AND (l.parent_executable IS NULL OR l.parent_executable = m1.parent) GROUP BY ALL),
esup AS (SELECT image_digest, w, source_id, min(by_id) AS by_id FROM dsup
  WHERE rule_id IN ('DET-002', 'DET-004') GROUP BY ALL),
m2 AS (SELECT m1.*, CASE WHEN m1.rule_id = 'DET-005' THEN coalesce(e1.by_id, e2.by_id) ELSE d.by_id END AS by_id
  FROM m1 LEFT JOIN dsup d USING (rule_id, image_digest, w, source_type, source_id)
  LEFT JOIN esup e1 ON e1.image_digest = m1.image_digest AND e1.w = m1.w AND e1.source_id = m1.shell_id
  LEFT JOIN esup e2 ON e2.image_digest = m1.image_digest AND e2.w = m1.w AND e2.source_id = m1.tool_id)"""

RUNS = """
agg AS (SELECT image_digest, w, count(*) FILTER (by_id IS NULL) AS matches,
    count(*) FILTER (by_id IS NULL AND eligible) AS eligible_matches,
    count(*) FILTER (by_id IS NOT NULL) AS suppressed_matches,
    max(sev) FILTER (by_id IS NULL AND eligible) AS max_sev,
    1 - product(1 - conf) FILTER (by_id IS NULL) AS noisy,
    count(DISTINCT source_type) FILTER (by_id IS NULL) AS source_types FROM m2 GROUP BY ALL),
runs0 AS (SELECT image_digest, w, exec_count, lifecycle_count, CASE WHEN exec_count > 0 THEN total END AS total,
    coalesce(matches, 0) AS matches, coalesce(eligible_matches, 0) AS eligible_matches,
    coalesce(suppressed_matches, 0) AS suppressed_matches, coalesce(source_types, 0) AS source_types,
    coalesce(noisy, 0) AS noisy, max_sev FROM sc LEFT JOIN agg USING (image_digest, w)),
runs1 AS (SELECT *, CASE WHEN exec_count = 0 THEN 'insufficient_data' WHEN eligible_matches > 0
      THEN 'incident_created' WHEN matches > 0 THEN 'findings_only' ELSE 'no_findings' END AS run_status,
    CASE WHEN exec_count = 0 THEN NULL WHEN eligible_matches > 0 THEN least(1.0, 0.65 * max_sev + 0.35 * total
      + least(0.12, 0.03 * (eligible_matches - 1))) ELSE 0.25 * total END AS severity,
    CASE WHEN exec_count = 0 THEN 0.0 ELSE least(1.0, 0.5 * noisy + 0.25 * least(1.0, source_types / 3)
      + 0.25 * (0.75 * least(1.0, exec_count / 5) + 0.25 * CASE WHEN lifecycle_count > 0 THEN 1 ELSE 0 END))
      END AS confidence FROM runs0),
runs AS (SELECT *, CASE WHEN exec_count = 0 THEN 'unknown' WHEN severity < 0.25 THEN 'low'
      WHEN severity < 0.5 THEN 'medium' WHEN severity < 0.75 THEN 'high' ELSE 'critical' END AS severity_level,
    CASE WHEN confidence < 0.35 THEN 'low' WHEN confidence < 0.7 THEN 'medium' ELSE 'high' END
      AS confidence_level FROM runs1),
inc AS (SELECT image_digest, w, 'incident:' || image_digest || ':' || w AS incident_id, runs.* EXCLUDE (image_digest, w),
    first_us, last_us, leading_rule, strong
  FROM runs JOIN (SELECT image_digest, w, min(us) AS first_us, max(us) AS last_us,
      arg_max(rule_id, (sev, conf, rule_id)) FILTER (eligible) AS leading_rule,
      bool_or(rule_id IN ('DET-005', 'DET-007')) AS strong FROM m2 WHERE by_id IS NULL GROUP BY ALL) f
    USING (image_digest, w) WHERE run_status = 'incident_created')"""


def seen_check(select: str) -> str:
    return check(TOKENS, IDENTITY, select=select)


def full(*parts: str, select: str) -> str:
    return check(TOKENS, DISTANCES, NUMBERS, SCORES, IDENTITY, MATCHES, *parts, select=select)


# --- the same in Spark -------------------------------------------------------------------


def allowlists(t: Tables) -> DataFrame:
    """Allowlist entries derived from the suppliers."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("bigint")
    text = lambda c: c.cast("string")
    return t.raw("supplier").select(
        F.concat(F.lit("a"), F.lpad(text(key), 6, "0")).alias("allowlist_id"),
        F.concat(F.lit("img"), text(key % 8)).alias("image_digest"),
        F.concat(F.lit("DET-00"), text(key % 6 + 2)).alias("rule_id"),
        F.when(key % 3 == 1, "/bin/sh")
        .when(key % 3 == 2, F.concat(F.lit("/usr/bin/click-"), text(nation % 10 + 90)))
        .alias("executable"),
        F.when(key % 5 < 2, F.concat(F.lit("/sbin/p"), text(nation % 5))).alias("parent_executable"),
        (F.col("s_acctbal") > 1000).alias("active"),
        F.when(
            key % 4 == 0, F.timestamp_micros(F.lit(CUT_US) + (nation - 12) * F.lit(DAY_US))
        ).alias("expires_at"),
    )


def live_allowlists(t: Tables) -> DataFrame:
    return rules.active_allowlists(allowlists(t), F.timestamp_micros(F.lit(CUT_US)))


def detection(t: Tables, custom: list[dict] | None = None) -> Detection:
    return Detection(behaviour(t), live_allowlists(t), custom, DAY, LOOKBACK)


def plain_match(df: DataFrame) -> DataFrame:
    return df.select("image_digest", "w", "rule_id", F.unix_micros("occurred_at").alias("us"), "source_id")


def rule_query(name: str, rule_id: str, build) -> None:
    """Register one rule: ``build(detection) -> matches``."""

    @query(name, full(select=f"SELECT image_digest, w, rule_id, us, source_id FROM m1 WHERE rule_id = '{rule_id}'"))
    def run(t: Tables) -> DataFrame:
        d = detection(t)
        return plain_match(rules.only_scored(build(d), d.scores))


def _unseen(d: Detection) -> DataFrame:
    return d.unseen


@query(
    "det0_identity_resolution",
    seen_check("SELECT event_id, program, ppath AS program_path, par_path AS parent_path FROM idn"),
)
def identity_resolution(t: Tables) -> DataFrame:
    out = rules.resolve_identity(t.execs)
    return out.select("event_id", "program", "program_path", "parent_path")


@query("det0b_seen", seen_check("SELECT event_id, NOT unseen AS seen FROM flagged"))
def seen(t: Tables) -> DataFrame:
    d = detection(t)
    return rules.seen_flags(rules.resolve_identity(d.execs), d.behaviour.baseline).select("event_id", "seen")


rule_query("det1_high_distance", "DET-001", lambda d: rules.high_distance(d.scores, d.window_end))
rule_query("det2_new_shell", "DET-002", lambda d: rules.new_shell(_unseen(d)))
rule_query(
    "det3_new_root",
    "DET-003",
    lambda d: rules.new_root(rules.resolve_identity(d.execs), d.behaviour.baseline),
)
rule_query("det4_new_tool", "DET-004", lambda d: rules.new_tool(_unseen(d)))
rule_query("det6_exec_activity", "DET-006", lambda d: rules.exec_activity(d.lifecycle))
rule_query("det7_privileged_start", "DET-007", lambda d: rules.privileged_start(d.lifecycle))


@query(
    "det4_surplus_tools",
    seen_check("""SELECT image_digest, w, greatest(count(*) - 10, 0) AS additional_unseen_executables
      FROM tools GROUP BY ALL"""),
)
def surplus_tools(t: Tables) -> DataFrame:
    return rules.surplus_tools(_unseen(detection(t)))


@query(
    "det5_shell_then_tool",
    full(select="""SELECT image_digest, w, shell_id AS shell_event_id, tool_id AS tool_event_id,
      elapsed AS elapsed_seconds FROM pairs"""),
)
def shell_then_tool(t: Tables) -> DataFrame:
    pairs = rules.shell_then_tool_pairs(_unseen(detection(t)), DAY)
    return pairs.select("image_digest", "w", "shell_event_id", "tool_event_id", "elapsed_seconds")


@query(
    "det5_pair_counts",
    full(select="""SELECT image_digest, w, container_id, tool_id AS tool_event_id, count(*) AS shells FROM pairs GROUP BY ALL"""),
)
def pair_counts(t: Tables) -> DataFrame:
    return rules.shell_then_tool_counts(_unseen(detection(t)), DAY)


@query(
    "det5_pair_counts_all",
    duck_prefix("ex") + f""" SELECT a.image_digest, a.container_id, b.event_id AS tool_event_id, count(*) AS shells
      FROM ex a JOIN ex b ON a.container_id = b.container_id AND b.us >= a.us AND b.us <= a.us + {DAY_US}
      WHERE a.process_name = 'sh' AND b.process_name = 'click' GROUP BY ALL""",
)
def pair_counts_all(t: Tables) -> DataFrame:
    """The same counting over all shells and clicks, known or not."""
    rows = t.execs.where("process_name IN ('sh', 'click')").withColumns(
        {"w": F.lit(0).cast("bigint"), "program": F.col("process_name")}
    )
    return rules.shell_then_tool_counts(rows, DAY).drop("w")


@query(
    "det17_matcher_hash",
    f"WITH {ALLOW.split('live AS')[0].strip().rstrip(',')}" + """ SELECT allowlist_id, sha256('{"executable":' || coalesce('"' || executable || '"', 'null')
      || ',"image_digest":"' || image_digest || '","parent_executable":' || coalesce('"' || parent_executable || '"', 'null')
      || ',"rule_id":"' || rule_id || '"}') AS matcher_hash FROM al""",
)
def matcher_hash(t: Tables) -> DataFrame:
    return allowlists(t).select("allowlist_id", rules.matcher_hash().alias("matcher_hash"))


@query(
    "det17_run_key",
    duck_prefix("ex") + f""", s AS (SELECT DISTINCT image_digest || ':' || ((us - {CUT_US}) // {DAY_US}) AS score_id FROM ex WHERE us >= {CUT_US})
    SELECT score_id, sha256('{{"allowlist_set_hash":"none","custom_ruleset_hash":"{rules.custom_ruleset_hash([])}","ruleset_hash":"{rules.ruleset_hash()}","score_id":"'
      || score_id || '"}}') AS run_key FROM s""",
)
def run_key(t: Tables) -> DataFrame:
    runs = behaviour(t).execs.where("w >= 0").select(rules.score_id().alias("score_id")).distinct()
    return runs.withColumn("run_key", rules.run_key(F.col("score_id"), "none", rules.custom_ruleset_hash([])))


CUSTOM = [
    {
        "slug": "nested",
        "name": "Nested",
        "category": "custom",
        "target": "process",
        "condition": {
            "all": [
                {"field": "executable", "op": "contains", "value": "CLICK-9"},
                {"any": [
                    {"field": "user_uid", "op": "equals", "value": "0"},
                    {"field": "parent_name", "op": "in", "value": ["P1", "p2"]},
                    {"not": {"field": "parent_executable", "op": "not_equals", "value": "p3"}},
                ]},
            ]
        },
        "severity_weight": 0.5,
        "confidence_weight": 0.6,
        "incident_eligible": False,
    },
    {
        "slug": "nulls",
        "name": "Absent values differ from every value",
        "category": "custom",
        "target": "process",
        "condition": {
            "all": [
                {"field": "user_uid", "op": "not_in", "value": [1000, "0"]},
                {"field": "process_name", "op": "not_equals", "value": "sh"},
            ]
        },
        "severity_weight": 0.4,
        "confidence_weight": 0.5,
        "incident_eligible": True,
    },
    {
        "slug": "lineage",
        "name": "Click below a view",
        "category": "custom",
        "target": "process",
        "condition": {
            "all": [
                {"field": "process_name", "op": "equals", "value": "click"},
                {"field": "executable", "op": "contains", "value": "view", "scope": "ancestor"},
            ]
        },
        "severity_weight": 0.6,
        "confidence_weight": 0.7,
        "incident_eligible": True,
    },
    {
        "slug": "text",
        "name": "Written as text",
        "category": "custom",
        "target": "process",
        "condition": "executable = 'sh' AND exists(ancestors, a -> a.parent_executable IN ('p1', 'p2'))",
        "severity_weight": 0.6,
        "confidence_weight": 0.7,
        "incident_eligible": True,
    },
    {
        "slug": "privileged",
        "name": "Privileged image",
        "category": "custom",
        "target": "lifecycle",
        "condition": {
            "all": [
                {"field": "privileged", "op": "equals", "value": True},
                {"field": "image_digest", "op": "in", "value": ["img1", "img5"]},
            ]
        },
        "severity_weight": 0.7,
        "confidence_weight": 0.8,
        "incident_eligible": True,
    },
    {"slug": "off", "target": "process", "enabled": False},
    {"slug": "broken", "category": "x", "target": "process", "severity_weight": 1, "confidence_weight": 1,
     "incident_eligible": True, "condition": {"field": "nope", "op": "equals", "value": 1}},
    {"slug": "shapeless", "target": "process", "condition": {"all": []}},
    {"slug": "unknown-word", "category": "x", "target": "process", "severity_weight": 1,
     "confidence_weight": 1, "incident_eligible": True, "condition": "java_method('x') = 'y'"},
    {"slug": "unfinished", "category": "x", "target": "process", "severity_weight": 1,
     "confidence_weight": 1, "incident_eligible": True, "condition": "executable = "},
    {"slug": "not-boolean", "category": "x", "target": "process", "severity_weight": 1,
     "confidence_weight": 1, "incident_eligible": True, "condition": "executable"},
    {"slug": "no-list", "category": "x", "target": "process", "severity_weight": 1,
     "confidence_weight": 1, "incident_eligible": True, "condition": "exists(executable, a -> true)"},
]

CUSTOM_SQL = f"""
pw AS (SELECT p.event_id, arg_max(q.event_id, (q.time_nano, q.event_id)) AS parent_event_id
    FROM idn p JOIN idn q ON q.process_pid = p.process_ppid AND q.time_nano <= p.time_nano
      AND q.us >= p.us - {LOOKBACK * 1_000_000} AND q.event_id <> p.event_id AND q.w >= 0
      AND q.docker_host_id = p.docker_host_id AND q.container_id = p.container_id
    WHERE p.process_ppid > 0 AND p.w >= 0 GROUP BY ALL),
lw AS (SELECT idn.*, parent_event_id, lower(coalesce(regexp_extract(par_path, '[^/]*$'), '')) AS par_base
  FROM idn LEFT JOIN pw USING (event_id) WHERE w >= 0),
up AS (SELECT l.event_id, l.image_digest, l.w, p.event_id AS node, 1 AS depth FROM lw l JOIN lw p
    ON p.event_id = l.parent_event_id AND p.image_digest = l.image_digest AND p.w = l.w
  UNION ALL SELECT u.event_id, u.image_digest, u.w, p.event_id, u.depth + 1 FROM up u
    JOIN lw l ON l.event_id = u.node JOIN lw p ON p.event_id = l.parent_event_id
      AND p.image_digest = u.image_digest AND p.w = u.w),
anc AS (SELECT up.event_id, lw.program, lw.par_base FROM up JOIN lw ON lw.event_id = up.node),
cm AS (
  SELECT image_digest, w, 'CUS-nested' AS rule_id, event_id AS source_id FROM lw
    WHERE contains(program, 'click-9') AND (coalesce(user_uid = 0, false)
      OR lower(coalesce(parent_name, '')) IN ('p2') OR par_base = 'p3')
  UNION ALL SELECT image_digest, w, 'CUS-nulls', event_id FROM lw
    WHERE coalesce(user_uid NOT IN (1000, 0), true) AND coalesce(process_name, '') <> 'sh'
  UNION ALL SELECT image_digest, w, 'CUS-lineage', event_id FROM lw WHERE process_name = 'click'
    AND event_id IN (SELECT event_id FROM anc WHERE contains(program, 'view'))
  UNION ALL SELECT image_digest, w, 'CUS-text', event_id FROM lw WHERE program = 'sh'
    AND event_id IN (SELECT event_id FROM anc WHERE par_base IN ('p1', 'p2'))
  UNION ALL SELECT image_digest, w, 'CUS-privileged', event_id FROM lcw
    WHERE w >= 0 AND privileged AND image_digest IN ('img1', 'img5'))"""


def custom_check(select: str) -> str:
    return recursive(check(TOKENS, IDENTITY, CUSTOM_SQL, select=select))


@query("det8_custom_rules", custom_check("SELECT image_digest, w, rule_id, source_id FROM cm"))
def custom(t: Tables) -> DataFrame:
    found, _ = detection(t, CUSTOM).custom_results
    return found.select("image_digest", "w", "rule_id", "source_id")


@query(
    "det8c_rule_errors",
    custom_check("""SELECT rule_id, count(*) AS matches, NULL AS error_class FROM cm GROUP BY 1
      UNION ALL SELECT 'CUS-' || slug, NULL, e FROM (VALUES ('broken', 'ValueError'), ('shapeless', 'ValueError'), ('unknown-word', 'ValueError'),
        ('unfinished', 'ParseException'), ('not-boolean', 'ValueError'), ('no-list', 'AnalysisException')) v(slug, e)"""),
)
def rule_errors(t: Tables) -> DataFrame:
    """Matches per rule next to the errors of the rules that could not be compiled."""
    found, errors = detection(t, CUSTOM).custom_results
    counts = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"))
    wrong = errors.select(
        F.concat(F.lit(config.CUSTOM_RULE_PREFIX), "slug").alias("rule_id"),
        F.substring_index("error", ":", 1).alias("error_class"),
    )
    return counts.join(wrong, "rule_id", "full_outer")


@query(
    "det9_deduplicate",
    duck_prefix("ex") + """ SELECT image_digest, w, rule_id, source_type, source_id, max(us) AS us FROM (
      SELECT image_digest, n % 10 AS w, 'DET-00' || (k % 3 + 1) AS rule_id, 'process_event' AS source_type,
        container_id AS source_id, us FROM ex) GROUP BY ALL""",
)
def deduplicate(t: Tables) -> DataFrame:
    """Repeated matches: the container stands in for the source, so keys repeat."""
    rows = t.execs.select(
        "image_digest",
        (F.col("n") % 10).alias("w"),
        F.concat(F.lit("DET-00"), (F.col("k") % 3 + 1).cast("string")).alias("rule_id"),
        F.lit("process_event").alias("source_type"),
        F.col("container_id").alias("source_id"),
        "occurred_at",
        "event_id",
    )
    keys = ["image_digest", "w", "rule_id", "source_type", "source_id"]
    return rules.deduplicate(rows).select(*keys, F.unix_micros("occurred_at").alias("us"))


@query(
    "det_all_matches",
    full(select="SELECT image_digest, w, rule_id, us, source_id FROM m1"),
)
def all_matches(t: Tables) -> DataFrame:
    return plain_match(detection(t).raw_matches)


@query(
    "det10_allowlists",
    full(ALLOW, select="SELECT image_digest, w, rule_id, source_id, by_id AS suppressed_by FROM m2"),
)
def apply_allowlists(t: Tables) -> DataFrame:
    return detection(t).matches.select("image_digest", "w", "rule_id", "source_id", "suppressed_by")


@query(
    "det18_active_allowlists",
    f"WITH {ALLOW.split('live AS')[0].strip().rstrip(',')} SELECT allowlist_id, image_digest, rule_id FROM al "
    f"WHERE active AND (expires_us IS NULL OR expires_us > {CUT_US})",
)
def active_allowlists(t: Tables) -> DataFrame:
    live = rules.active_allowlists(allowlists(t), F.timestamp_micros(F.lit(CUT_US)))
    return live.select("allowlist_id", "image_digest", "rule_id")


@query(
    "det_unique_active_allowlists",
    f"WITH {ALLOW.split('live AS')[0].strip().rstrip(',')} SELECT allowlist_id, row_number() OVER (PARTITION BY "
    "image_digest, rule_id, executable, parent_executable ORDER BY allowlist_id) AS copy FROM al "
    "WHERE active QUALIFY copy > 1",
)
def unique_active(t: Tables) -> DataFrame:
    return rules.unique_active(allowlists(t)).select("allowlist_id", F.col("copy").cast("bigint").alias("copy"))


@query(
    "agg19_noisy_or",
    full(ALLOW, RUNS, select="SELECT image_digest, w, round(noisy, 9) AS combined_confidence FROM agg WHERE matches > 0"),
)
def noisy_or(t: Tables) -> DataFrame:
    out = incidents.summarize_matches(detection(t).matches).where("matches > 0")
    return out.select("image_digest", "w", r9("combined_confidence"))


@query(
    "det11_to_14_detection_runs",
    full(ALLOW, RUNS, select="""SELECT image_digest, w, run_status, exec_count, lifecycle_count, matches,
      eligible_matches, suppressed_matches, source_types, round(severity, 9) AS severity_score, severity_level,
      round(confidence, 9) AS confidence_score, confidence_level FROM runs"""),
)
def detection_runs(t: Tables) -> DataFrame:
    return detection(t).runs.drop("total_score").withColumns(
        {c: r9(c) for c in ("severity_score", "confidence_score")}
    )


@query(
    "det15_incidents",
    full(ALLOW, RUNS, select="""SELECT incident_id, image_digest, w, leading_rule, matches, first_us, last_us,
      severity_level, confidence_level FROM inc"""),
)
def incident_table(t: Tables) -> DataFrame:
    return detection(t).incidents.select(
        "incident_id",
        "image_digest",
        "w",
        "leading_rule",
        "matches",
        F.unix_micros("first_seen_at").alias("first_us"),
        F.unix_micros("last_seen_at").alias("last_us"),
        "severity_level",
        "confidence_level",
    )


@query(
    "det15_incident_containers",
    full(ALLOW, RUNS, select="""SELECT DISTINCT inc.incident_id, m2.container_id FROM m2
      JOIN inc USING (image_digest, w) WHERE by_id IS NULL AND m2.container_id IS NOT NULL"""),
)
def incident_containers(t: Tables) -> DataFrame:
    d = detection(t)
    return d.incidents.join(d.containers, rules.RUN).select("incident_id", "container_id")


TIMELINE = f"""
tl AS (SELECT image_digest, w, us, source_type, source_id, rule_id, category AS evidence_type FROM m2
    WHERE by_id IS NULL AND (image_digest, w) IN (SELECT (image_digest, w) FROM inc)
  UNION ALL SELECT image_digest, w, {CUT_US} + (w + 1) * {DAY_US}, 'anomaly_score', image_digest || ':' || w, NULL,
    'behavioural_distance' FROM inc),
tln AS (SELECT *, row_number() OVER (PARTITION BY image_digest, w
    ORDER BY us, source_type, source_id, coalesce(rule_id, '')) AS sequence_no FROM tl)"""


@query(
    "det16_timeline",
    full(ALLOW, RUNS, TIMELINE, select="SELECT image_digest, w, us, source_type, source_id, rule_id, evidence_type, sequence_no FROM tln"),
)
def timeline(t: Tables) -> DataFrame:
    lines = detection(t).timeline
    return lines.select(
        "image_digest", "w", F.unix_micros("occurred_at").alias("us"), "source_type", "source_id",
        "rule_id", "evidence_type", "sequence_no",
    )


@query("win6_timeline_numbering", duck_prefix("ex") + """ SELECT event_id, row_number() OVER (
      PARTITION BY image_digest ORDER BY us, event_id) AS sequence_no FROM ex""")
def timeline_numbering(t: Tables) -> DataFrame:
    from runwarden.operators.ordering import Ordered

    rows = t.execs.select("image_digest", "us", "event_id")
    return Ordered(rows, ["image_digest"], ["us", "event_id"]).number("sequence_no").rows.select(
        "event_id", "sequence_no"
    )


CHANGES = """ch AS (SELECT 'i' || (o_custkey % 400) AS incident_id, epoch_us(o_orderdate) AS changed_us,
    'c' || lpad(cast(o_orderkey AS varchar), 9, '0') AS change_id,
    CASE o_orderkey % 7 WHEN 0 THEN 'resolved' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'open'
      ELSE 'acknowledged' END AS new_status FROM orders),
  num AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY changed_us, change_id, new_status) AS i FROM ch),
  walk AS (SELECT incident_id, cast(0 AS bigint) AS i, 'open' AS status, cast(NULL AS varchar) AS change_id,
      cast(NULL AS varchar) AS before, cast(NULL AS varchar) AS result FROM num WHERE i = 1
    UNION ALL SELECT w.incident_id, n.i, CASE WHEN ok THEN new_status ELSE status END, n.change_id, status,
      CASE WHEN new_status = status THEN 'unchanged' WHEN ok THEN 'applied' ELSE 'rejected' END
    FROM walk w JOIN num n ON n.incident_id = w.incident_id AND n.i = w.i + 1,
      LATERAL (SELECT (status = 'open' AND new_status IN ('acknowledged', 'resolved', 'dismissed'))
        OR (status = 'acknowledged' AND new_status IN ('resolved', 'dismissed')) AS ok) x)"""


@query(
    "det19_status_fold",
    "WITH RECURSIVE " + CHANGES + """ SELECT incident_id, change_id, before, result,
      last_value(status) OVER (PARTITION BY incident_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
        AND UNBOUNDED FOLLOWING) AS status FROM walk WHERE i > 0""",
)
def status_fold(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    status = (
        F.when(key % 7 == 0, "resolved")
        .when(key % 7 == 1, "dismissed")
        .when(key % 7 == 2, "open")
        .otherwise("acknowledged")
    )
    changes = t.raw("orders").select(
        F.concat(F.lit("i"), (F.col("o_custkey") % 400).cast("string")).alias("incident_id"),
        F.col("o_orderdate").cast("timestamp").alias("changed_at"),
        F.concat(F.lit("c"), F.lpad(key.cast("string"), 9, "0")).alias("change_id"),
        status.alias("new_status"),
    )
    return incidents.fold_status(changes)


@query(
    "det20_recommendations",
    full(ALLOW, RUNS, select="""SELECT incident_id, c.container_id, concat_ws(',', 'observe_only',
        CASE WHEN p THEN 'pause_container' END, CASE WHEN s THEN 'stop_container' END) AS allowed_actions,
      CASE WHEN s THEN 'stop_container' WHEN p THEN 'pause_container' ELSE 'observe_only' END AS recommended_action
    FROM inc LEFT JOIN (SELECT DISTINCT image_digest, w, container_id FROM m2 WHERE by_id IS NULL
        AND container_id IS NOT NULL) c USING (image_digest, w),
      LATERAL (SELECT c.container_id IS NOT NULL AND severity >= 0.7 AND confidence >= 0.55 AS p,
        c.container_id IS NOT NULL AND severity >= 0.9 AND confidence >= 0.75 AND strong AS s) x"""),
)
def recommendations(t: Tables) -> DataFrame:
    d = detection(t)
    out = incidents.recommend(d.incidents, d.containers)
    return out.drop("recommendation_key").withColumn("allowed_actions", F.array_join("allowed_actions", ","))


@query(
    "det21_new_alerts",
    full(ALLOW, RUNS, select="""SELECT incident_id, severity_level FROM inc
      WHERE severity_level IN ('high', 'critical') AND w NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 3)"""),
)
def new_alerts(t: Tables) -> DataFrame:
    d = detection(t)
    told = d.incidents.join(
        t.raw("nation").where("n_nationkey < 3").select(F.col("n_nationkey").cast("bigint").alias("w")),
        "w",
        "left_semi",
    )
    return incidents.new_alerts(d.incidents, told, "high").select("incident_id", "severity_level")


CHAINS = f"""
pw AS (SELECT p.event_id, arg_max(q.event_id, (q.time_nano, q.event_id)) AS parent_event_id
    FROM idn p JOIN idn q ON q.process_pid = p.process_ppid AND q.time_nano <= p.time_nano
      AND q.us >= p.us - {LOOKBACK * 1_000_000} AND q.event_id <> p.event_id AND q.w >= 0
      AND q.docker_host_id = p.docker_host_id AND q.container_id = p.container_id
    WHERE p.process_ppid > 0 AND p.w >= 0 GROUP BY ALL),
lw AS (SELECT idn.*, parent_event_id FROM idn LEFT JOIN pw USING (event_id) WHERE w >= 0),
up AS (SELECT event_id, image_digest, w, event_id AS node, 0 AS depth FROM lw
  UNION ALL SELECT u.event_id, u.image_digest, u.w, p.event_id, u.depth + 1 FROM up u
    JOIN lw l ON l.event_id = u.node JOIN lw p ON p.event_id = l.parent_event_id
      AND p.image_digest = u.image_digest AND p.w = u.w),
chain AS (SELECT event_id, string_agg(node, '>' ORDER BY depth) AS process_chain FROM up GROUP BY 1),
seen_as AS (SELECT x.image_digest, x.w, x.rule_id, x.source_type, x.source_id, elapsed, e.command_line, e.user_uid, e.executable AS raw_executable,
    e.parent_event_id, process_chain
  FROM (SELECT m2.*, pairs.elapsed, coalesce(m2.tool_id, CASE WHEN source_type = 'process_event' THEN source_id END) AS subject FROM m2
    LEFT JOIN pairs USING (image_digest, w, shell_id, tool_id)) x
  LEFT JOIN lw e ON e.event_id = subject AND e.image_digest = x.image_digest AND e.w = x.w
  LEFT JOIN chain ON chain.event_id = subject)"""


@query(
    "jn16_evidence_bundle",
    recursive(full(ALLOW, RUNS, TIMELINE, CHAINS, select=f"""SELECT incident_id, sequence_no, source_id, tln.rule_id, name,
      round(inc.total, 9) AS total_score, {BAND.format('inc.total')} AS score_band, command_line, cast(user_uid AS bigint) AS user_uid,
      raw_executable, parent_event_id, elapsed AS elapsed_seconds, process_chain
    FROM inc JOIN tln USING (image_digest, w) LEFT JOIN seen_as USING (image_digest, w, rule_id, source_type, source_id) LEFT JOIN (VALUES """
    + ", ".join(f"('{i}', '{n}')" for i, n in config.RULE_NAMES.items())
    + ") names(rule_id, name) ON names.rule_id = tln.rule_id")),
)
def evidence_bundle(t: Tables) -> DataFrame:
    """Every line of every incident with what its event looked like."""
    d = detection(t)
    names = t.spark.createDataFrame(list(config.RULE_NAMES.items()), "rule_id string, name string")
    out = incidents.evidence_bundle(d.incidents, d.scores, d.evidence_timeline, names)
    return out.select(
        "incident_id", "sequence_no", "source_id", "rule_id", "name", r9("total_score"), "score_band", "command_line",
        F.col("user_uid").cast("bigint").alias("user_uid"), "raw_executable", "parent_event_id", "elapsed_seconds",
        F.array_join("process_chain", ">").alias("process_chain"),
    )
