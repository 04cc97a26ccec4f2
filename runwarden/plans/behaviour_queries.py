"""Queries for profiles, distances and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.operators import profile, score
from runwarden.plans.behaviour import Behaviour, Interval, drift_ranking
from runwarden.plans.registry import query
from runwarden.plans.views import CUT_US, DAY_US, END_US, START_US, Tables, duck_prefix

INTERVAL = Interval(START_US, CUT_US, END_US, DAY_US)
KEY = ["image_digest", "w"]


def behaviour(t: Tables) -> Behaviour:
    return Behaviour(t.execs, t.lifecycle, INTERVAL)


def r9(name: str) -> F.Column:
    return F.round(F.col(name), 9).alias(name)


# --- the same tables in the checking SQL -------------------------------------------------

WINDOWS = f"""
exw AS (SELECT *, CASE WHEN us < {CUT_US} THEN (us - {START_US}) // {DAY_US} - 20
                       ELSE (us - {CUT_US}) // {DAY_US} END AS w,
  coalesce(nullif(trim(coalesce(nullif(executable, ''), process_name)), ''), '<unknown>') AS ptok,
  coalesce(nullif(trim(coalesce(nullif(parent_executable, ''), parent_name)), ''), '<unknown>')
    AS partok
  FROM ex),
lcw AS (SELECT *, CASE WHEN us < {CUT_US} THEN (us - {START_US}) // {DAY_US} - 20
                       ELSE (us - {CUT_US}) // {DAY_US} END AS w FROM lc)"""

TOKENS = """
big AS (SELECT image_digest, w, container_id, ptok,
    lead(ptok) OVER (PARTITION BY image_digest, w, container_id ORDER BY us, event_id) AS nxt
  FROM (SELECT * REPLACE (greatest(w, -1) AS w) FROM exw)),
tok AS (
  SELECT image_digest, w, 'process_name' AS family, coalesce(process_name, '<unknown>') AS token
    FROM exw
  UNION ALL SELECT image_digest, w, 'executable', ptok FROM exw
  UNION ALL SELECT image_digest, w, 'parent_child', partok || ' -> ' || ptok FROM exw
  UNION ALL SELECT image_digest, w, 'user_uid',
    coalesce(cast(user_uid AS varchar), '<unknown>') FROM exw
  UNION ALL SELECT image_digest, w, 'runtime_action', event_type || ':' || action FROM lcw
  UNION ALL SELECT image_digest, w, 'process_sequence_bigram', ptok || ' -> ' || nxt
    FROM big WHERE nxt IS NOT NULL),
cnt AS (SELECT image_digest, w, family, token, count(*) AS n FROM tok GROUP BY ALL),
base_tok AS (SELECT image_digest, family, token, sum(n) AS n FROM cnt WHERE w < 0 GROUP BY ALL),
obs AS (SELECT image_digest, w, family, token, n FROM cnt WHERE w >= 0),
base_tot AS (SELECT image_digest, family, sum(n) AS t FROM base_tok GROUP BY ALL),
obs_tot AS (SELECT image_digest, w, family, sum(n) AS t FROM obs GROUP BY ALL)"""

DISTANCES = """
support AS (
  SELECT o.image_digest, o.w, o.family, b.token FROM obs_tot o
    JOIN base_tok b ON b.image_digest = o.image_digest AND b.family = o.family
  UNION SELECT image_digest, w, family, token FROM obs),
pq AS (SELECT s.*, coalesce(b.n, 0) / bt.t AS p, coalesce(o.n, 0) / ot.t AS q,
    b.n IS NULL AS unseen, bt.t AS bt
  FROM support s
  LEFT JOIN base_tok b USING (image_digest, family, token)
  LEFT JOIN obs o USING (image_digest, w, family, token)
  LEFT JOIN base_tot bt USING (image_digest, family)
  JOIN obs_tot ot USING (image_digest, w, family)),
dist AS (SELECT image_digest, w, family,
    CASE WHEN max(bt) IS NULL THEN 1.0 ELSE round(sqrt(greatest(0.0, least(1.0,
      0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END)
      + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((coalesce(p, 0) + q) / 2)) ELSE 0 END)))), 12)
      END AS js,
    CASE WHEN max(bt) IS NULL THEN 1.0
      ELSE round(sqrt(0.5 * sum(power(sqrt(p) - sqrt(q), 2))), 12) END AS hel,
    round(coalesce(sum(q) FILTER (unseen), 0), 12) AS novelty,
    count(*) FILTER (unseen AND q > 0) AS unseen_tokens
  FROM pq GROUP BY ALL)"""

NUMBERS = """
nums AS (SELECT image_digest, w, count(*) FILTER (is_exec) AS exec_count,
    count(*) FILTER (NOT is_exec) AS lifecycle_count,
    count(DISTINCT ptok) AS distinct_processes, count(*) FILTER (uid = 0) AS roots,
    count(*) FILTER (shell) AS shells
  FROM (SELECT image_digest, w, true AS is_exec, ptok, user_uid AS uid,
          lower(coalesce(process_name, '')) IN ('ash','bash','csh','dash','fish','ksh','sh','tcsh','zsh')
          OR lower(regexp_extract(ptok, '[^/]*$')) IN
            ('ash','bash','csh','dash','fish','ksh','sh','tcsh','zsh') AS shell FROM exw
        UNION ALL SELECT image_digest, w, false, NULL, NULL, false FROM lcw) z
  GROUP BY ALL),
wspine AS (SELECT image_digest, w FROM (SELECT DISTINCT image_digest FROM nums WHERE w < 0),
  (SELECT unnest(range(-20, 10)) AS w)),
feat AS (SELECT s.image_digest, s.w, coalesce(exec_count, 0) AS exec_count,
    coalesce(lifecycle_count, 0) AS lifecycle_count, f.feature, f.value
  FROM wspine s LEFT JOIN nums n USING (image_digest, w),
  LATERAL (VALUES
    ('process_events_per_minute', coalesce(exec_count, 0) / 1440.0),
    ('runtime_events_per_minute', coalesce(lifecycle_count, 0) / 1440.0),
    ('distinct_processes_per_window', cast(coalesce(distinct_processes, 0) AS double)),
    ('root_process_ratio', coalesce(roots / nullif(exec_count, 0), 0.0)),
    ('shell_process_ratio', coalesce(shells / nullif(exec_count, 0), 0.0))) f(feature, value)),
summ AS (SELECT image_digest, feature, min(value) AS mn, max(value) AS mx, avg(value) AS mean,
    median(value) AS med, quantile_disc(value, 0.95) AS p95, stddev_pop(value) AS sd
  FROM feat WHERE w < 0 GROUP BY ALL),
dev AS (SELECT f.image_digest, f.w, f.feature, value, med, p95, sd,
    greatest(sd, abs(p95 - med) / 1.6448536269514722, abs(med) * 0.1,
      CASE WHEN feature LIKE '%ratio' THEN 0.05 ELSE 1.0 END) AS scale
  FROM feat f JOIN summ s USING (image_digest, feature) WHERE f.w >= 0),
dev2 AS (SELECT *, abs(value - med) / scale AS z,
    round(greatest(0.0, least(1.0, (abs(value - med) / scale - 2) / 4)), 12) AS deviation FROM dev)"""

SCORES = """
fw(family, fweight) AS (VALUES ('process_name', 0.15), ('executable', 0.25),
  ('parent_child', 0.2), ('user_uid', 0.1), ('runtime_action', 0.1),
  ('process_sequence_bigram', 0.2)),
nw(feature, nweight) AS (VALUES ('process_events_per_minute', 0.25),
  ('runtime_events_per_minute', 0.1), ('distinct_processes_per_window', 0.25),
  ('root_process_ratio', 0.2), ('shell_process_ratio', 0.2)),
cat AS (SELECT image_digest, w, round(sum(fweight * js) / sum(fweight), 12) AS cat,
    round(sum(fweight * novelty) / sum(fweight), 12) AS nov, sum(fweight) AS fsum
  FROM dist JOIN fw USING (family) GROUP BY ALL),
num AS (SELECT image_digest, w, round(sum(nweight * deviation) / sum(nweight), 12) AS num
  FROM dev2 JOIN nw USING (feature) GROUP BY ALL),
sc AS (SELECT s.image_digest, s.w, coalesce(n.exec_count, 0) AS exec_count,
    coalesce(n.lifecycle_count, 0) AS lifecycle_count, cat, nov, num, fsum,
    CASE WHEN cat IS NULL THEN 0 ELSE 0.8 END + CASE WHEN num IS NULL THEN 0 ELSE 0.2 END AS gsum,
    round((coalesce(0.5 * cat, 0) + coalesce(0.3 * nov, 0) + coalesce(0.2 * num, 0))
      / (CASE WHEN cat IS NULL THEN 0 ELSE 0.8 END + CASE WHEN num IS NULL THEN 0 ELSE 0.2 END), 12)
      AS total
  FROM (SELECT * FROM wspine WHERE w >= 0) s LEFT JOIN nums n USING (image_digest, w)
  LEFT JOIN cat USING (image_digest, w) LEFT JOIN num USING (image_digest, w))"""

BAND = """CASE WHEN {0} < 0.25 THEN 'baseline_like' WHEN {0} < 0.5 THEN 'elevated'
  WHEN {0} < 0.75 THEN 'high' ELSE 'extreme' END"""


def check(*parts: str, select: str) -> str:
    return ",".join([duck_prefix("ex", "lc"), WINDOWS, *parts]) + "\n" + select


# --- flagship ----------------------------------------------------------------------------


@query(
    "flagship_drift_ranking",
    check(
        TOKENS,
        DISTANCES,
        select=f"""SELECT image_digest, w, cast(t AS bigint) AS exec_count, round(js, 9) AS js_distance,
          round(novelty, 9) AS novelty, {BAND.format('js')} AS score_band
        FROM dist JOIN obs_tot USING (image_digest, w, family) WHERE family = 'executable'""",
    ),
)
def flagship(t: Tables) -> DataFrame:
    return drift_ranking(t.execs, INTERVAL)


# --- profiles ----------------------------------------------------------------------------


@query(
    "agg1_token_counts",
    check(TOKENS, select="""SELECT image_digest, family, token, cast(n AS bigint) AS n FROM base_tok
        WHERE family <> 'process_sequence_bigram'"""),
)
def token_counts(t: Tables) -> DataFrame:
    b = behaviour(t)
    return profile.token_counts(
        b.execs.where("w < 0"), b.lifecycle.where("w < 0"), ["image_digest"]
    )


@query(
    "agg2_distribution",
    check(TOKENS, select="""SELECT image_digest, family, token, cast(n AS bigint) AS n,
        round(n / t, 9) AS p FROM base_tok JOIN base_tot USING (image_digest, family)"""),
)
def distribution(t: Tables) -> DataFrame:
    return profile.distribution(behaviour(t).baseline, ["image_digest"]).withColumn("p", r9("p"))


@query(
    "agg3_sequence_bigrams",
    check(TOKENS, select="""SELECT image_digest, greatest(w, -1) AS w, family, token, cast(n AS bigint) AS n
        FROM cnt WHERE family = 'process_sequence_bigram'"""),
)
def sequence_bigrams(t: Tables) -> DataFrame:
    b = behaviour(t)
    rows = b.execs.withColumn("w", F.greatest("w", F.lit(-1).cast("bigint")))
    return profile.sequence_bigrams(rows, KEY)


@query(
    "agg3_conversation_bigrams",
    """SELECT role || ' -> ' || nxt AS token, count(*) AS n FROM (
      SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
    WHERE nxt IS NOT NULL GROUP BY 1""",
)
def conversation_bigrams(t: Tables) -> DataFrame:
    rows = t.raw("conversations").select(
        F.lit("all").alias("scope"),
        F.col("conv_id").cast("string").alias("container_id"),
        F.col("turn").alias("occurred_at"),
        F.col("turn").alias("event_id"),
        F.col("role").alias("executable"),
        F.col("role").alias("process_name"),
    )
    return profile.sequence_bigrams(rows, ["scope"]).select("token", "n")


NUMBER_SELECT = """SELECT image_digest, w, exec_count, lifecycle_count,
  round(exec_count / 1440.0, 9) AS process_events_per_minute,
  round(lifecycle_count / 1440.0, 9) AS runtime_events_per_minute,
  round(cast({d} AS double), 9) AS distinct_processes_per_window,
  round(coalesce(roots / nullif(exec_count, 0), 0.0), 9) AS root_process_ratio,
  round(coalesce(shells / nullif(exec_count, 0), 0.0), 9) AS shell_process_ratio FROM nums"""


@query("agg4_window_numeric", check(TOKENS, NUMBERS, select=NUMBER_SELECT.format(d="distinct_processes")))
def window_numeric(t: Tables) -> DataFrame:
    numbers = behaviour(t).numbers
    doubles = [c for c, kind in numbers.dtypes if kind == "double"]
    return numbers.withColumns({c: r9(c) for c in doubles})


@query(
    "agg4_empty_windows_filled",
    duck_prefix("ex") + f""", c AS (SELECT container_id, (us - {START_US}) // 3600000000 AS w, count(*) AS n
      FROM ex GROUP BY ALL)
    SELECT s.container_id, count(*) AS windows, count(n) AS nonempty,
      cast(coalesce(sum(n), 0) AS bigint) AS n
    FROM (SELECT DISTINCT container_id, unnest(range(720)) AS w FROM ex) s
    LEFT JOIN c USING (container_id, w) GROUP BY ALL""",
)
def empty_windows(t: Tables) -> DataFrame:
    """Hourly windows of every container over the whole interval, gaps included."""
    at = profile.micros(F.col("occurred_at"))
    rows = t.execs.select(
        F.col("container_id").alias("image_digest"),
        profile.window_index(at, START_US, 3_600_000_000, END_US).alias("w"),
    )
    counts = rows.groupBy("image_digest", "w").agg(F.count(F.lit(1)).alias("n"))
    spine = profile.window_spine(counts, 0, 720)
    filled = profile.fill_windows(counts.withColumn("hit", F.lit(1).cast("bigint")), spine)
    return filled.groupBy(F.col("image_digest").alias("container_id")).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("hit").alias("nonempty"), F.sum("n").alias("n")
    )


@query(
    "agg5_window_index",
    duck_prefix("ex") + f""" SELECT event_id, least(greatest(cast(floor((us - {START_US + DAY_US}) / 7000000000) AS bigint),
        0), 246) AS w FROM ex""",
)
def window_index(t: Tables) -> DataFrame:
    """7 000 s windows anchored on the second day, ending early: both ends clamp."""
    at = profile.micros(F.col("occurred_at"))
    start = START_US + DAY_US
    index = profile.window_index(at, start, 7_000_000_000, start + 247 * 7_000_000_000)
    return t.execs.select("event_id", index.alias("w"))


@query(
    "agg6_numeric_summary",
    check(TOKENS, NUMBERS, select="""SELECT image_digest, feature, round(mn, 9) AS min, round(mx, 9) AS max,
        round(mean, 9) AS mean, round(med, 9) AS median, round(p95, 9) AS p95, round(sd, 9) AS stddev
        FROM summ"""),
)
def numeric_summary(t: Tables) -> DataFrame:
    names = ["min", "max", "mean", "median", "p95", "stddev"]
    return behaviour(t).numeric_summary.select("image_digest", "feature", *[r9(n) for n in names])


@query(
    "agg7_observed_sets",
    check(TOKENS, select="SELECT DISTINCT image_digest, w, family, token FROM obs"),
)
def observed_sets(t: Tables) -> DataFrame:
    return profile.observed_sets(behaviour(t).observed, KEY)


@query(
    "agg8_profile_manifest",
    check(select="""SELECT image_digest, count(*) FILTER (e) AS process_event_count,
        count(*) FILTER (NOT e) AS runtime_event_count,
        count(DISTINCT container_id) AS container_count,
        min(us) FILTER (e) AS first_process_at, max(us) FILTER (e) AS last_process_at,
        min(us) FILTER (NOT e) AS first_runtime_at, max(us) FILTER (NOT e) AS last_runtime_at
      FROM (SELECT image_digest, container_id, us, true AS e FROM exw WHERE w < 0
        UNION ALL SELECT image_digest, container_id, us, false FROM lcw WHERE w < 0)
      GROUP BY ALL"""),
)
def profile_manifest(t: Tables) -> DataFrame:
    b = behaviour(t)
    out = profile.profile_manifest(b.execs.where("w < 0"), b.lifecycle.where("w < 0"))
    times = [c for c, kind in out.dtypes if kind == "timestamp"]
    return out.withColumns({c: F.unix_micros(c) for c in times})


@query(
    "agg9_event_set_hash",
    check(select="""SELECT image_digest, w, cast(sum(n) AS bigint) AS event_count,
        sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) AS event_set_sha256
      FROM (SELECT image_digest, w, substr(sha256(id), 1, 2) AS bucket, count(*) AS n,
          sha256(string_agg(id, chr(10) ORDER BY id)) AS digest
        FROM (SELECT image_digest, w, 'process:' || event_id AS id FROM exw WHERE w >= 0
          UNION ALL SELECT image_digest, w, 'runtime:' || event_id FROM lcw WHERE w >= 0)
        GROUP BY ALL) GROUP BY ALL"""),
)
def event_set_hash(t: Tables) -> DataFrame:
    b = behaviour(t)
    ids = profile.labelled_ids(b.execs.where("w >= 0"), b.lifecycle.where("w >= 0"), KEY)
    return profile.event_set_hash(ids, KEY).drop("event_set_fingerprint")


@query(
    "agg9_event_set_fingerprint",
    check(select="""SELECT image_digest, count(*) AS event_count, sha256(concat_ws(':', count(*),
        sum(('0x' || substr(h, 1, 15))::ubigint), sum(('0x' || substr(h, 16, 15))::ubigint),
        sum(('0x' || substr(h, 31, 15))::ubigint), sum(('0x' || substr(h, 46, 15))::ubigint)))
        AS event_set_fingerprint
      FROM (SELECT image_digest, sha256('process:' || event_id) AS h FROM exw
        UNION ALL SELECT image_digest, sha256('runtime:' || event_id) FROM lcw)
      GROUP BY ALL"""),
)
def event_set_fingerprint(t: Tables) -> DataFrame:
    ids = profile.labelled_ids(t.execs, t.lifecycle, ["image_digest"])
    return profile.event_set_fingerprint(ids, ["image_digest"])


@query(
    "agg10_quality_gate",
    check(TOKENS, NUMBERS, select="""SELECT image_digest, p AS process_event_count, nw AS nonempty_windows,
        p >= 400 AS enough_process_events, nw >= 10 AS enough_windows, true AS has_digest,
        p >= 400 AND nw >= 10 AS passed,
        concat_ws(',', CASE WHEN c < 2 THEN 'few_containers' END,
          CASE WHEN l = 0 THEN 'no_lifecycle_events' END,
          CASE WHEN coalesce(b, 0) = 0 THEN 'no_sequence_bigrams' END) AS warnings
      FROM (SELECT image_digest, count(*) AS p, count(DISTINCT container_id) AS c FROM exw WHERE w < 0
            GROUP BY ALL) a
      JOIN (SELECT image_digest, count(*) AS l FROM lcw WHERE w < 0 GROUP BY ALL) USING (image_digest)
      JOIN (SELECT image_digest, count(*) AS nw FROM nums WHERE w < 0 GROUP BY ALL) USING (image_digest)
      LEFT JOIN (SELECT image_digest, count(*) AS b FROM base_tok
        WHERE family = 'process_sequence_bigram' GROUP BY ALL) USING (image_digest)"""),
)
def quality_gate(t: Tables) -> DataFrame:
    b = behaviour(t)
    manifest = profile.profile_manifest(b.execs.where("w < 0"), b.lifecycle.where("w < 0"))
    bigrams = b.baseline.where("family = 'process_sequence_bigram'")
    gate = profile.quality_gate(manifest, b.numbers.where("w < 0"), bigrams, 400, 10)
    return gate.withColumn("warnings", F.array_join("warnings", ","))


# --- distance and score ------------------------------------------------------------------


@query(
    "sco1_js_distance",
    check(TOKENS, DISTANCES, select="SELECT image_digest, w, family, round(js, 9) AS js_distance FROM dist"),
)
def js_distance(t: Tables) -> DataFrame:
    return behaviour(t).families.select(*KEY, "family", r9("js_distance"))


@query(
    "sco2_novelty",
    check(TOKENS, DISTANCES, select="""SELECT image_digest, w, family, round(novelty, 9) AS novelty,
      unseen_tokens FROM dist"""),
)
def novelty(t: Tables) -> DataFrame:
    return behaviour(t).families.select(*KEY, "family", r9("novelty"), "unseen_tokens")


@query(
    "sco3_numeric_deviation",
    check(TOKENS, NUMBERS, select="""SELECT image_digest, w, feature, round(value, 9) AS observed,
      round(scale, 9) AS scale, round(z, 9) AS abs_z, round(deviation, 9) AS deviation FROM dev2"""),
)
def numeric_deviation(t: Tables) -> DataFrame:
    names = ["observed", "scale", "abs_z", "deviation"]
    return behaviour(t).deviations.select(*KEY, "feature", *[r9(n) for n in names])


@query(
    "sco4_weighted_average",
    """WITH m AS (SELECT l_orderkey AS k, (l_linenumber - 1) % 3 + 1 AS name,
        CASE WHEN l_discount > 0 THEN l_discount END AS v FROM lineitem),
      a AS (SELECT k, name, avg(v) AS v FROM m GROUP BY ALL)
    SELECT k, round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 9) AS average
    FROM a JOIN (VALUES (1, 0.5), (2, 0.3), (3, 0.2)) t(name, w) USING (name) GROUP BY k""",
)
def weighted_average(t: Tables) -> DataFrame:
    """Discount per order over three groups of its lines, missing ones rescaled away."""
    value = F.when(F.col("l_discount") > 0, F.col("l_discount"))
    rows = (
        t.raw("lineitem")
        .groupBy(F.col("l_orderkey").alias("k"), ((F.col("l_linenumber") - 1) % 3 + 1).cast("string").alias("name"))
        .agg(F.avg(value).alias("v"))
    )
    weights = {"1": 0.5, "2": 0.3, "3": 0.2}
    return score.weighted_average(rows, ["k"], "name", "v", weights, "average").select("k", r9("average"))


SCORE_SELECT = f"""SELECT image_digest, w, exec_count, lifecycle_count, 'scored' AS status,
  round(total, 9) AS total_score, {BAND.format('total')} AS score_band,
  round(cat, 9) AS categorical_distance, round(nov, 9) AS novelty_score,
  round(num, 9) AS numeric_deviation FROM sc WHERE exec_count >= {{minimum}}"""


@query(
    "sco5_anomaly_score",
    check(TOKENS, DISTANCES, NUMBERS, SCORES, select=SCORE_SELECT.format(minimum=1) + """
      UNION ALL SELECT image_digest, w, exec_count, lifecycle_count, 'insufficient_data', NULL,
        'insufficient_data', NULL, NULL, NULL FROM sc WHERE exec_count < 1"""),
)
def anomaly_score(t: Tables) -> DataFrame:
    return _scores(t, 1)


def _scores(t: Tables, minimum: int) -> DataFrame:
    names = ["total_score", "categorical_distance", "novelty_score", "numeric_deviation"]
    out = behaviour(t).scores(minimum)
    return out.select(
        *KEY, "exec_count", "lifecycle_count", "status", "score_band", *[r9(n) for n in names]
    )


@query(
    "sco6_score_band",
    "WITH d AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS v FROM lineitem) "
    f"SELECT {BAND.format('v')} AS score_band, count(*) AS n FROM d GROUP BY 1",
)
def score_band(t: Tables) -> DataFrame:
    band = score.band(F.col("l_discount") * 10).alias("score_band")
    return t.raw("lineitem").groupBy(band).agg(F.count(F.lit(1)).alias("n"))


CONTRIBUTIONS = """
con AS (
  SELECT image_digest, w, 'categorical_distance' AS kind, family AS feature, js AS raw_score,
    0.5 / gsum * fweight / fsum * js AS contribution
  FROM dist JOIN fw USING (family) JOIN sc USING (image_digest, w) WHERE exec_count > 0
  UNION ALL SELECT image_digest, w, 'novelty', family, novelty, 0.3 / gsum * fweight / fsum * novelty
  FROM dist JOIN fw USING (family) JOIN sc USING (image_digest, w) WHERE exec_count > 0
  UNION ALL SELECT image_digest, w, 'numeric_deviation', feature, deviation, 0.2 / gsum * nweight * deviation
  FROM dev2 JOIN nw USING (feature) JOIN sc USING (image_digest, w) WHERE exec_count > 0)"""


@query(
    "sco7_top_contributors",
    check(TOKENS, DISTANCES, NUMBERS, SCORES, CONTRIBUTIONS, select="""SELECT image_digest, w,
        row_number() OVER (PARTITION BY image_digest, w
          ORDER BY round(contribution, 12) DESC, kind, feature) AS rank,
        kind, feature, round(raw_score, 9) AS raw_score, round(contribution, 9) AS contribution
      FROM con QUALIFY rank <= 12"""),
)
def top_contributors(t: Tables) -> DataFrame:
    b = behaviour(t)
    top = score.top_contributors(score.contributions(b.scores(), b.families, b.deviations))
    return top.select(
        *KEY, F.col("rank").cast("bigint").alias("rank"), "kind", "feature", r9("raw_score"), r9("contribution")
    )


@query(
    "sco7_top_unseen",
    check(TOKENS, select="""SELECT o.image_digest, o.w, row_number() OVER (PARTITION BY o.image_digest, o.w
          ORDER BY round(o.n / t, 12) DESC, o.family, o.token) AS rank,
        o.family, o.token, round(o.n / t, 9) AS proportion
      FROM obs o JOIN obs_tot USING (image_digest, w, family)
      LEFT JOIN base_tok b ON b.image_digest = o.image_digest AND b.family = o.family AND b.token = o.token
      WHERE b.token IS NULL QUALIFY rank <= 25"""),
)
def top_unseen(t: Tables) -> DataFrame:
    b = behaviour(t)
    top = score.top_unseen(b.baseline, score.token_shares(b.observed))
    return top.select(*KEY, F.col("rank").cast("bigint").alias("rank"), "family", "token", r9("proportion"))


@query(
    "sco7_top_observed",
    check(TOKENS, select="""SELECT image_digest, w, family, row_number() OVER (PARTITION BY image_digest, w, family
          ORDER BY round(n / t, 12) DESC, token) AS rank, token, round(n / t, 9) AS proportion
      FROM obs JOIN obs_tot USING (image_digest, w, family) QUALIFY rank <= 10"""),
)
def top_observed(t: Tables) -> DataFrame:
    top = score.top_observed(score.token_shares(behaviour(t).observed))
    return top.select(*KEY, "family", F.col("rank").cast("bigint").alias("rank"), "token", r9("proportion"))


@query(
    "sco7_top_numeric",
    check(TOKENS, NUMBERS, select="""SELECT image_digest, w, row_number() OVER (PARTITION BY image_digest, w
          ORDER BY round(deviation, 12) DESC, feature) AS rank, feature,
        round(deviation, 9) AS deviation FROM dev2 QUALIFY rank <= 10"""),
)
def top_numeric(t: Tables) -> DataFrame:
    top = score.top_numeric(behaviour(t).deviations)
    return top.select(*KEY, F.col("rank").cast("bigint").alias("rank"), "feature", r9("deviation"))


@query(
    "sco8_insufficient_data",
    check(TOKENS, DISTANCES, NUMBERS, SCORES, select=SCORE_SELECT.format(minimum=25) + """
      UNION ALL SELECT image_digest, w, exec_count, lifecycle_count, 'insufficient_data', NULL,
        'insufficient_data', NULL, NULL, NULL FROM sc WHERE exec_count < 25"""),
)
def insufficient_data(t: Tables) -> DataFrame:
    return _scores(t, 25)


@query(
    "sco10_hellinger",
    check(TOKENS, DISTANCES, select="SELECT image_digest, w, family, round(hel, 9) AS hellinger FROM dist"),
)
def hellinger(t: Tables) -> DataFrame:
    return behaviour(t).families.select(*KEY, "family", r9("hellinger"))


@query(
    "jn7_novel_tokens",
    check(TOKENS, select="""SELECT o.image_digest, o.w, o.family, o.token, cast(o.n AS bigint) AS n FROM obs o
      WHERE NOT EXISTS (SELECT 1 FROM base_tok b WHERE b.image_digest = o.image_digest
        AND b.family = o.family AND b.token = o.token)"""),
)
def novel_tokens(t: Tables) -> DataFrame:
    b = behaviour(t)
    return score.novel_tokens(b.baseline, b.observed).select(*KEY, "family", "token", "n")


@query(
    "sco9_observation_key",
    check(select=f"""SELECT image_digest, w, event_count, sha256('{{"event_set":"' || fp || '","profile_id":"profile:' || image_digest
        || '","profile_model_hash":"v1","scoring_config":"{score.scoring_config_hash()}","window_end":' || ({CUT_US} + (w + 1) * {DAY_US})
        || ',"window_start":' || ({CUT_US} + w * {DAY_US}) || '}}') AS observation_key
      FROM (SELECT image_digest, w, count(*) AS event_count, sha256(concat_ws(':', count(*),
        sum(('0x' || substr(h, 1, 15))::ubigint), sum(('0x' || substr(h, 16, 15))::ubigint),
        sum(('0x' || substr(h, 31, 15))::ubigint), sum(('0x' || substr(h, 46, 15))::ubigint))) AS fp
      FROM (SELECT image_digest, w, sha256('process:' || event_id) AS h FROM exw WHERE w >= 0
        UNION ALL SELECT image_digest, w, sha256('runtime:' || event_id) FROM lcw WHERE w >= 0) GROUP BY ALL)"""),
)
def observation_key(t: Tables) -> DataFrame:
    """One key per image and scoring window; equal event sets give equal keys."""
    b = behaviour(t)
    ids = profile.labelled_ids(b.execs.where("w >= 0"), b.lifecycle.where("w >= 0"), KEY)
    prints = profile.event_set_fingerprint(ids, KEY)
    start = F.lit(CUT_US) + F.col("w") * F.lit(DAY_US)
    key = score.observation_key(
        F.concat(F.lit("profile:"), "image_digest"), F.lit("v1"), start, start + F.lit(DAY_US), F.col("event_set_fingerprint")
    )
    return prints.select(*KEY, "event_count", key.alias("observation_key"))
