"""Queries for calibrated rarity and detector evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden import config
from runwarden.functions.hashing import assign_split
from runwarden.operators import evaluate, profile, rarity
from runwarden.plans.behaviour_queries import KEY, TOKENS, behaviour, check, r9
from runwarden.plans.enrich_queries import recursive
from runwarden.plans.registry import query
from runwarden.plans.views import CUT_US, Tables, duck_prefix
from runwarden.session import materialize

CONTRASTS = [
    ("CONTEXT_vs_GLOBAL", "ARM-CONTEXT", "ARM-GLOBAL"),
    ("CONTEXT_vs_TAG", "ARM-CONTEXT", "ARM-TAG"),
    ("CONTEXT_vs_DIGEST", "ARM-CONTEXT", "ARM-DIGEST"),
]


def exact9(name: str) -> F.Column:
    """Nine digits of a value that often lies exactly between two of them, like k / 2^10."""
    return F.round(F.round(F.col(name), 12), 9).alias(name)


# --- rarity ------------------------------------------------------------------------------


@query(
    "sco11_novelty_mass",
    check(TOKENS, select="""SELECT o.image_digest, o.w, o.family, round(coalesce(sum(o.n) FILTER (b.token IS NULL), 0) / sum(o.n), 9)
        AS score, count(*) FILTER (b.token IS NULL) AS unseen_tokens
      FROM obs o LEFT JOIN base_tok b ON b.image_digest = o.image_digest AND b.family = o.family
        AND b.token = o.token GROUP BY ALL"""),
)
def novelty_mass(t: Tables) -> DataFrame:
    b = behaviour(t)
    found = rarity.novelty_mass(b.baseline, b.observed, [*KEY, "family"], ["image_digest", "family"])
    return found.select(*KEY, "family", r9("score"), "unseen_tokens")


TRANSITIONS = f"""tr AS (SELECT image_digest, phase, ptok AS source, nxt AS target, count(*) AS n FROM (
    SELECT image_digest, phase, ptok, lead(ptok) OVER (PARTITION BY image_digest, phase, container_id
      ORDER BY us, event_id) AS nxt FROM (SELECT *, us >= {CUT_US} AS phase FROM exw))
    WHERE nxt IS NOT NULL GROUP BY ALL),
  fit AS (SELECT * FROM tr WHERE NOT phase), seen AS (SELECT * FROM tr WHERE phase),
  voc AS (SELECT image_digest, count(DISTINCT target) AS v FROM tr GROUP BY 1),
  rs AS (SELECT image_digest, source, sum(n) AS r FROM fit GROUP BY ALL)"""


@query(
    "sco12_markov_surprisal",
    check(TRANSITIONS, select="""SELECT s.image_digest, round(sum(s.n * -log2((coalesce(f.n, 0) + 1.0) / (coalesce(r, 0) + v)))
        / sum(s.n), 9) AS score, cast(sum(s.n) AS bigint) AS transition_count,
      cast(coalesce(sum(s.n) FILTER (f.n IS NULL), 0) AS bigint) AS unseen_count,
      count(*) FILTER (f.n IS NULL) AS unseen_transitions
    FROM seen s LEFT JOIN fit f USING (image_digest, source, target)
    LEFT JOIN rs USING (image_digest, source) JOIN voc USING (image_digest) GROUP BY ALL"""),
)
def markov_surprisal(t: Tables) -> DataFrame:
    rows = t.execs.select(
        "image_digest",
        (F.col("us") >= CUT_US).alias("phase"),
        "container_id",
        "us",
        "event_id",
        profile.process_token().alias("token"),
    )
    pairs = rarity.transitions(rows, ["image_digest", "phase"], "container_id", ["us", "event_id"], "token")
    fit, seen = pairs.where("NOT phase").drop("phase"), pairs.where("phase").drop("phase")
    return rarity.markov_surprisal(fit, seen, ["image_digest"]).withColumn("score", r9("score"))


@query(
    "sco12_conversation_surprisal",
    """WITH tr AS (SELECT half, role AS source, nxt AS target, count(*) AS n FROM (SELECT conv_id % 2 AS half, role,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL GROUP BY ALL),
      rs AS (SELECT source, sum(n) AS r FROM tr WHERE half = 0 GROUP BY 1)
    SELECT round(sum(s.n * -log2((coalesce(f.n, 0) + 1.0) / (coalesce(r, 0) + (SELECT count(DISTINCT target) FROM tr))))
      / sum(s.n), 9) AS score, cast(sum(s.n) AS bigint) AS transition_count
    FROM (SELECT * FROM tr WHERE half = 1) s LEFT JOIN (SELECT * FROM tr WHERE half = 0) f USING (source, target)
    LEFT JOIN rs USING (source)""",
)
def conversation_surprisal(t: Tables) -> DataFrame:
    rows = t.raw("conversations").select(
        F.lit("all").alias("k"), (F.col("conv_id") % 2).alias("half"), "conv_id", "turn", "role"
    )
    pairs = rarity.transitions(rows, ["k", "half"], "conv_id", ["turn"], "role")
    out = rarity.markov_surprisal(
        pairs.where("half = 0").drop("half"), pairs.where("half = 1").drop("half"), ["k"]
    )
    return out.select(r9("score"), "transition_count")


@query(
    "sco13_empirical_pvalue",
    """WITH cal AS (SELECT l_suppkey AS model, l_quantity AS v FROM lineitem WHERE l_linenumber % 2 = 0),
      tst AS (SELECT l_suppkey AS model, l_orderkey, l_linenumber, l_quantity + l_discount * 100 - 5 AS v FROM lineitem
        WHERE l_linenumber % 2 = 1),
      x AS (SELECT DISTINCT model, v FROM tst),
      e AS (SELECT x.model, x.v, count(cal.v) AS n, count(*) FILTER (cal.v >= x.v) AS above
        FROM x LEFT JOIN cal USING (model) GROUP BY ALL)
    SELECT model, l_orderkey, l_linenumber, n AS calibration_n, CASE WHEN n > 0 THEN above END AS exceedances,
      CASE WHEN n > 0 THEN round((1 + above) / (n + 1), 9) END AS p_value,
      CASE WHEN n > 0 THEN 'calibrated' ELSE 'insufficient_data' END AS status
    FROM tst JOIN e USING (model, v)""",
)
def empirical_pvalue(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").withColumnRenamed("l_suppkey", "model")
    calibration = rows.where("l_linenumber % 2 = 0").select(
        "model", F.col("l_quantity").alias("value")
    )
    tests = rows.where("l_linenumber % 2 = 1").select(
        "model",
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") + F.col("l_discount") * 100 - 5).alias("value"),
    )
    out = rarity.empirical_pvalues(calibration, tests, ["model"])
    return out.drop("value", "rarity").withColumn("p_value", r9("p_value"))


@query(
    "sco14_fuse_ranks",
    """WITH c(i, component) AS (VALUES (1, 'categorical_shift'), (2, 'sequence_surprisal'), (3, 'novelty_mass'), (4, 'numeric_tail')),
      r AS (SELECT l_orderkey AS k, component, CASE WHEN max(l_discount) > 0.03 THEN max(l_discount) * 10 END AS v
        FROM lineitem JOIN c ON i = (l_linenumber - 1) % 4 + 1 GROUP BY ALL)
    SELECT k, round(avg(v), 9) AS rarity, concat_ws(',',
        CASE WHEN count(v) FILTER (component = 'categorical_shift') = 0 THEN 'categorical_shift' END,
        CASE WHEN count(v) FILTER (component = 'novelty_mass') = 0 THEN 'novelty_mass' END,
        CASE WHEN count(v) FILTER (component = 'numeric_tail') = 0 THEN 'numeric_tail' END,
        CASE WHEN count(v) FILTER (component = 'sequence_surprisal') = 0 THEN 'sequence_surprisal' END) AS missing,
      CASE WHEN count(v) = 0 THEN 'insufficient_data' ELSE 'calibrated' END AS status FROM r GROUP BY k""",
)
def fuse_ranks(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(c) for c in config.RARITY_COMPONENTS])
    top = F.max("l_discount")
    rows = (
        t.raw("lineitem")
        .groupBy(
            F.col("l_orderkey").alias("k"),
            F.element_at(names, ((F.col("l_linenumber") - 1) % 4 + 1).cast("int")).alias("component"),
        )
        .agg(F.when(top > 0.03, top * 10).alias("rarity"))
    )
    out = rarity.fuse_ranks(rows, ["k"])
    return out.select("k", r9("rarity"), F.array_join("missing", ",").alias("missing"), "status")


@query(
    "agg22_block_statistic",
    """SELECT o_custkey AS run_id, max(o_totalprice) AS block_statistic, count(*) AS windows, true AS valid
    FROM orders GROUP BY ALL""",
)
def block_statistic(t: Tables) -> DataFrame:
    rows = t.raw("orders").select(F.col("o_custkey").alias("run_id"), F.col("o_totalprice").alias("value"))
    return rarity.block_statistics(rows, ["run_id"])


MODELS = """mo AS (SELECT 'M' || n_nationkey AS model_id, 'ctx' || (n_nationkey % 3) AS ctx FROM nation),
  bl AS (SELECT 'M' || s_nationkey AS model_id, 'S' || s_suppkey AS run_id, abs(s_acctbal) AS v FROM supplier),
  te AS (SELECT 'T' || c_custkey AS test_id, 'M' || c_nationkey AS model_id,
    CASE WHEN c_custkey % 10 = 0 THEN 'S' || (c_custkey % 100) ELSE 'C' || c_custkey END AS run_id,
    CASE WHEN c_custkey % 4 > 0 THEN 'ctx' || (c_custkey % 3) END AS tctx, abs(c_acctbal) AS v FROM customer)"""


def rarity_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    nation = F.col("n_nationkey")
    models = t.raw("nation").select(
        text("M", nation).alias("model_id"), text("ctx", nation % 3).alias("profile_context_hash")
    )
    blocks = t.raw("supplier").select(
        text("M", F.col("s_nationkey")).alias("model_id"),
        text("S", F.col("s_suppkey")).alias("run_id"),
        F.abs("s_acctbal").alias("value"),
    )
    key = F.col("c_custkey")
    tests = t.raw("customer").select(
        text("T", key).alias("test_id"),
        text("M", F.col("c_nationkey")).alias("model_id"),
        F.when(key % 10 == 0, text("S", key % 100)).otherwise(text("C", key)).alias("test_run_id"),
        F.when(key % 4 > 0, text("ctx", key % 3)).alias("test_context_hash"),
        F.abs("c_acctbal").alias("value"),
    )
    return tests, models, blocks


@query(
    "sco16_drift_gate",
    "WITH " + MODELS + """, z AS (SELECT test_id, model_id, te.v,
        EXISTS (SELECT 1 FROM bl WHERE bl.model_id = te.model_id AND bl.run_id = te.run_id) AS member,
        coalesce(tctx <> ctx, false) AS drifted, (SELECT count(*) FROM bl WHERE bl.model_id = te.model_id) AS n,
        (SELECT count(*) FROM bl WHERE bl.model_id = te.model_id AND bl.v >= te.v) AS above
      FROM te JOIN mo USING (model_id))
    SELECT test_id, model_id, n AS calibration_n, CASE WHEN member THEN 'overlaps_model' WHEN drifted THEN 'drift_detected'
        WHEN n > 0 THEN 'calibrated' ELSE 'insufficient_data' END AS status,
      CASE WHEN NOT member AND NOT drifted AND n > 0 THEN round((1 + above) / (n + 1), 9) END AS p_value FROM z""",
)
def drift_gate(t: Tables) -> DataFrame:
    return rarity.score_test_blocks(*rarity_inputs(t)).drop("rarity").withColumn("p_value", r9("p_value"))


@query(
    "eva11_calibration_artifact",
    "WITH " + MODELS + """, h AS (SELECT model_id, run_id, sha256(run_id || '=' || cast(cast(round(v, 9) AS decimal(38,9))
        AS varchar)) AS h FROM bl)
    SELECT model_id, count(*) AS runs, true AS values_valid, count(*) >= 5 AS usable,
      sha256(concat_ws(':', count(*), sum(('0x' || substr(h, 1, 15))::ubigint), sum(('0x' || substr(h, 16, 15))::ubigint),
        sum(('0x' || substr(h, 31, 15))::ubigint), sum(('0x' || substr(h, 46, 15))::ubigint))) AS calibration_hash
    FROM h GROUP BY ALL""",
)
def calibration_artifact(t: Tables) -> DataFrame:
    return rarity.calibration_artifacts(rarity_inputs(t)[2], 5)


# --- trials ------------------------------------------------------------------------------

SPLIT = "CASE (('0x' || substr(sha256({0}), 1, 16))::ubigint) % 3 WHEN 0 THEN 'fit' WHEN 1 THEN 'calibration' ELSE 'test' END"

TRIALS = f"""tr AS (SELECT *, {SPLIT.format('trial_id')} AS split FROM trial WHERE status = 'completed'),
  tt AS (SELECT 'trial-' || u AS trial_id, coalesce(process_name, '<unknown>') AS token, count(*) AS n FROM ex GROUP BY ALL),
  sk AS (SELECT tr.*, scope, ref FROM tr, LATERAL (VALUES ('ARM-GLOBAL', 'global'), ('ARM-TAG', human_tag),
    ('ARM-DIGEST', image_digest), ('ARM-CONTEXT', image_digest || '::' || context_hash)) v(scope, ref)),
  refs AS (SELECT scope, ref, token, sum(n) AS n FROM sk JOIN tt USING (trial_id)
    WHERE split = 'fit' AND NOT attack_like GROUP BY ALL),
  rt AS (SELECT scope, ref, sum(n) AS t FROM refs GROUP BY ALL),
  ot AS (SELECT trial_id, sum(n) AS t FROM tt GROUP BY ALL),
  sup AS (SELECT scope, ref, trial_id, token FROM sk JOIN refs USING (scope, ref)
    UNION SELECT scope, ref, trial_id, token FROM sk JOIN tt USING (trial_id)),
  sj AS (SELECT scope, ref, trial_id, sqrt(greatest(0.0, least(1.0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END)
      + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)))) AS js
    FROM (SELECT sup.scope, sup.ref, sup.trial_id, coalesce(r.n, 0) / rt.t AS p, coalesce(tt.n, 0) / ot.t AS q FROM sup
      JOIN rt ON rt.scope = sup.scope AND rt.ref = sup.ref JOIN ot ON ot.trial_id = sup.trial_id
      LEFT JOIN refs r ON r.scope = sup.scope AND r.ref = sup.ref AND r.token = sup.token
      LEFT JOIN tt ON tt.trial_id = sup.trial_id AND tt.token = sup.token) GROUP BY ALL),
  sd AS (SELECT sk.*, js, rt.t IS NOT NULL AS known, coalesce(js >= 0.25, false) AS positive
    FROM sk LEFT JOIN rt USING (scope, ref) LEFT JOIN sj USING (scope, ref, trial_id)),
  oc AS (SELECT scope, count(*) FILTER (known AND NOT attack_like) AS benign_runs,
      count(*) FILTER (known AND NOT attack_like AND positive) AS false_positives,
      count(*) FILTER (known AND attack_like) AS scenario_runs,
      count(*) FILTER (known AND attack_like AND positive) AS true_positives,
      count(*) FILTER (NOT known) AS insufficient_profile_runs FROM sd WHERE split = 'test' GROUP BY ALL)"""

TESTS = """arms(contrast, a, b) AS (VALUES ('CONTEXT_vs_GLOBAL', 'ARM-CONTEXT', 'ARM-GLOBAL'),
    ('CONTEXT_vs_TAG', 'ARM-CONTEXT', 'ARM-TAG'), ('CONTEXT_vs_DIGEST', 'ARM-CONTEXT', 'ARM-DIGEST')),
  pc AS (SELECT contrast, x.trial_id, x.positive AS a, y.positive AS b FROM arms JOIN sd x ON x.scope = arms.a
    JOIN sd y ON y.scope = arms.b AND y.trial_id = x.trial_id WHERE x.split = 'test' AND NOT x.attack_like
    AND x.known AND y.known),
  mc AS (SELECT contrast, count(*) AS n_pairs, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b,
    count(*) FILTER (a) AS a_positives, count(*) FILTER (b) AS b_positives FROM pc GROUP BY ALL),
  mp AS (SELECT *, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, (SELECT 2 * sum(exp(lgamma(only_a + only_b + 1)
      - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2)))
    FROM range(0, 100000) r(i) WHERE i BETWEEN greatest(only_a, only_b) AND only_a + only_b)) END AS p_value FROM mc),
  dg AS (SELECT *, CASE WHEN a_positives IN (0, n_pairs) THEN 'arm_a_constant' WHEN b_positives IN (0, n_pairs)
    THEN 'arm_b_constant' WHEN only_a + only_b = 0 THEN 'no_discordant_pairs' ELSE 'informative' END AS degeneracy FROM mp),
  hm AS (SELECT *, max(least(1.0, p_value * (m - rk + 1))) OVER (ORDER BY p_value, contrast ROWS UNBOUNDED PRECEDING) AS adj
    FROM (SELECT *, row_number() OVER (ORDER BY p_value, contrast) AS rk, count(*) OVER () AS m FROM dg))"""


def trial_check(*parts: str, select: str) -> str:
    return ",".join([duck_prefix("ex", "trial"), TRIALS, *parts]) + "\n" + select


def trials(t: Tables) -> DataFrame:
    return evaluate.split_trials(t.trials.where("status = 'completed'"))


def trial_tokens(t: Tables) -> DataFrame:
    from runwarden.functions.text import token

    name = F.concat(F.lit("trial-"), F.col("u").cast("string")).alias("trial_id")
    return t.execs.groupBy(name, token(F.col("process_name")).alias("token")).agg(
        F.count(F.lit(1)).alias("n")
    )


def scored(t: Tables) -> DataFrame:
    scoped, tokens = evaluate.scope_keys(trials(t)), trial_tokens(t)
    return evaluate.scope_distances(scoped, tokens, evaluate.scope_references(scoped, tokens))


@query("fn2_assign_split", f"SELECT o_orderkey, {SPLIT.format("'run-' || o_orderkey")} AS split FROM orders")
def fn2(t: Tables) -> DataFrame:
    name = F.concat(F.lit("run-"), F.col("o_orderkey").cast("string"))
    return t.raw("orders").select("o_orderkey", assign_split(name).alias("split"))


@query("fn9_scope_key", trial_check(select="SELECT trial_id, scope, ref AS reference_key FROM sk"))
def scope_key(t: Tables) -> DataFrame:
    return evaluate.scope_keys(trials(t)).select("trial_id", "scope", "reference_key")


@query(
    "agg17_scope_references",
    trial_check(select="SELECT scope, ref AS reference_key, token, cast(n AS bigint) AS n FROM refs"),
)
def scope_references(t: Tables) -> DataFrame:
    return evaluate.scope_references(evaluate.scope_keys(trials(t)), trial_tokens(t))


@query(
    "jn11_scope_reference_join",
    trial_check(select="""SELECT trial_id, scope, ref AS reference_key, known AS has_reference, round(js, 9) AS js_distance,
      positive, CASE WHEN known THEN 'scored' ELSE 'insufficient_profile' END AS outcome FROM sd"""),
)
def scope_reference_join(t: Tables) -> DataFrame:
    names = ["trial_id", "scope", "reference_key", "has_reference", "positive", "outcome"]
    return scored(t).select(*names, r9("js_distance"))


@query("agg18_scope_outcomes", trial_check(select="SELECT * FROM oc"))
def scope_outcomes(t: Tables) -> DataFrame:
    return evaluate.scope_outcomes(scored(t))


@query(
    "eva8_scope_experiment",
    trial_check(select="""SELECT scope, round(false_positives / nullif(benign_runs, 0), 9) AS fpr,
      round(true_positives / nullif(scenario_runs, 0), 9) AS recall FROM oc"""),
)
def scope_experiment(t: Tables) -> DataFrame:
    def rate(hits: str, runs: str) -> F.Column:
        return F.round(F.when(F.col(runs) > 0, F.col(hits) / F.col(runs)), 9)

    return evaluate.scope_outcomes(scored(t)).select(
        "scope",
        rate("false_positives", "benign_runs").alias("fpr"),
        rate("true_positives", "scenario_runs").alias("recall"),
    )


# The limits by bisection on the summed tail; the upper one is the lower one of the failures.
_TAIL = """list_sum(list_transform(range(x, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
      + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2))))"""
INTERVALS = f"""cn AS (SELECT DISTINCT x, n FROM (SELECT unnest([false_positives, benign_runs - false_positives]) AS x, benign_runs AS n FROM oc
    UNION ALL SELECT unnest([true_positives, scenario_runs - true_positives]), scenario_runs FROM oc) WHERE x > 0),
  bi AS (SELECT x, n, 0.0::double AS lo, 1.0::double AS hi, 0 AS step FROM cn
    UNION ALL SELECT x, n, CASE WHEN {_TAIL} < 0.025 THEN (lo + hi) / 2 ELSE lo END,
      CASE WHEN {_TAIL} < 0.025 THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM bi WHERE step < 45),
  li AS (SELECT x, n, (lo + hi) / 2 AS p FROM bi WHERE step = 45)"""


def _interval_sql(hits: str, runs: str, name: str) -> str:
    low = "coalesce((SELECT max(p) FROM li WHERE n = {1} AND x = {0}), 0)"
    return f"""round({hits} / nullif({runs}, 0), 9) AS {name}_point, round({low.format(hits, runs)}, 8) AS {name}_lower,
      round(1 - {low.format(f"{runs} - {hits}", runs)}, 8) AS {name}_upper"""


@query(
    "eva4_exact_intervals",
    recursive(trial_check(INTERVALS, select=f"""SELECT *, {_interval_sql("false_positives", "benign_runs", "fpr")},
      {_interval_sql("true_positives", "scenario_runs", "recall")} FROM oc""")),
)
def exact_intervals(t: Tables) -> DataFrame:
    """False-positive rate and recall per scope with exact intervals."""
    out = evaluate.with_interval(
        evaluate.scope_outcomes(scored(t)), "false_positives", "benign_runs", "fpr"
    )
    out = evaluate.with_interval(out, "true_positives", "scenario_runs", "recall")
    places = {"point": 9, "lower": 8, "upper": 8}
    return out.withColumns({f"{m}_{k}": F.round(f"{m}_{k}", p) for m in ("fpr", "recall") for k, p in places.items()})


COVERAGE = """tf AS (SELECT DISTINCT scope, ref, image_digest, context_hash FROM sd WHERE split = 'fit' AND NOT attack_like),
  fv AS (SELECT scope, ref, round(js, 12) AS js FROM sd WHERE split = 'fit' AND NOT attack_like AND known AND js IS NOT NULL),
  cv AS (SELECT c.trial_id, c.scope, c.ref, c.known, tf.ref IS NOT NULL AS trained, count(fv.js) AS n,
      count(*) FILTER (fv.js >= round(c.js, 12)) AS above
    FROM sd c LEFT JOIN tf ON tf.scope = c.scope AND tf.ref = c.ref AND tf.image_digest = c.image_digest
      AND tf.context_hash = c.context_hash
    LEFT JOIN fv ON fv.scope = c.scope AND fv.ref = c.ref
    WHERE c.split = 'calibration' AND NOT c.attack_like GROUP BY ALL),
  cw AS (SELECT *, CASE WHEN NOT known THEN 'insufficient_profile' WHEN NOT trained THEN 'drift_detected'
      ELSE 'scored' END AS status, CASE WHEN known AND trained AND n > 0 THEN (1 + above) / (n + 1) END AS p FROM cv)"""


@query(
    "eva9_calibration_coverage",
    trial_check(COVERAGE, select="""SELECT scope, count(*) AS calibration_trials, count(*) FILTER (p > 0.05) AS covered,
      count(*) FILTER (status = 'drift_detected') AS drift_detected_runs,
      count(*) FILTER (status = 'insufficient_profile') AS insufficient_profile_runs FROM cw GROUP BY ALL"""),
)
def calibration_coverage(t: Tables) -> DataFrame:
    return evaluate.coverage_summary(evaluate.calibration_rows(scored(t)))


@query(
    "eva9_calibration_rows",
    trial_check(COVERAGE, select="SELECT trial_id, scope, status, round(p, 9) AS p_value FROM cw"),
)
def calibration_rows(t: Tables) -> DataFrame:
    return evaluate.calibration_rows(scored(t)).select("trial_id", "scope", "status", r9("p_value"))


@query("jn12_paired_arms", trial_check(TESTS, select="SELECT contrast, trial_id, a, b FROM pc"))
def paired_arms(t: Tables) -> DataFrame:
    return evaluate.paired_calls(scored(t), CONTRASTS)


@query(
    "eva2_mcnemar",
    trial_check(TESTS, select="SELECT contrast, n_pairs, only_a, only_b, round(round(p_value, 12), 9) AS p_value FROM mp"),
)
def mcnemar(t: Tables) -> DataFrame:
    out = evaluate.mcnemar(evaluate.paired_calls(scored(t), CONTRASTS))
    return out.select("contrast", "n_pairs", "only_a", "only_b", exact9("p_value"))


@query(
    "eva2_mcnemar_parts",
    """WITH c AS (SELECT l_partkey % 500 AS contrast, count(*) FILTER (l_discount > 0.05 AND l_tax <= 0.04) AS a,
        count(*) FILTER (l_discount <= 0.05 AND l_tax > 0.04) AS b FROM lineitem GROUP BY 1)
    SELECT contrast, a AS only_a, b AS only_b, CASE WHEN a + b = 0 THEN 1.0 ELSE round(round(least(1.0, (SELECT 2 * sum(exp(lgamma(a + b + 1)
      - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))) FROM range(0, 5000) r(i)
      WHERE i BETWEEN greatest(a, b) AND a + b)), 12), 9) END AS p_value FROM c""",
)
def mcnemar_parts(t: Tables) -> DataFrame:
    """The same test for 500 groups of parts: deep discount against high tax."""
    pairs = t.raw("lineitem").select(
        (F.col("l_partkey") % 500).alias("contrast"),
        (F.col("l_discount") > 0.05).alias("a"),
        (F.col("l_tax") > 0.04).alias("b"),
    )
    return evaluate.mcnemar(pairs).select("contrast", "only_a", "only_b", exact9("p_value"))


@query(
    "eva3_holm",
    """WITH p AS (SELECT c_nationkey AS family, c_custkey AS contrast, (abs(c_acctbal) % 100) / 1000 AS p FROM customer)
    SELECT family, contrast, round(max(least(1.0, p * (m - rk + 1))) OVER (PARTITION BY family ORDER BY p, contrast
      ROWS UNBOUNDED PRECEDING), 9) AS adjusted_p FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, contrast)
      AS rk, count(*) OVER (PARTITION BY family) AS m FROM p)""",
)
def holm(t: Tables) -> DataFrame:
    tests = t.raw("customer").select(
        F.col("c_nationkey").alias("family"),
        F.col("c_custkey").alias("contrast"),
        ((F.abs("c_acctbal") % 100) / 1000).alias("p_value"),
    )
    return evaluate.holm(tests).select("family", "contrast", r9("adjusted_p"))


@query("win7_holm_contrasts", trial_check(TESTS, select="SELECT contrast, round(adj, 9) AS adjusted_p, adj < 0.05 AS rejected FROM hm"))
def holm_contrasts(t: Tables) -> DataFrame:
    tested = evaluate.mcnemar(evaluate.paired_calls(scored(t), CONTRASTS))
    out = evaluate.holm(tested.withColumn("family", F.lit("primary")))
    return out.select("contrast", r9("adjusted_p"), "rejected")


@query(
    "eva7_degeneracy",
    trial_check(TESTS, select="SELECT contrast, degeneracy, degeneracy = 'informative' AS informative FROM dg"),
)
def degeneracy(t: Tables) -> DataFrame:
    tested = evaluate.mcnemar(evaluate.paired_calls(scored(t), CONTRASTS))
    return evaluate.degeneracy(tested).select("contrast", "degeneracy", "informative")


def bootstrap_sql(condition: str) -> str:
    """Interval of recall per scope: each draw is the binomial quantile of a hash, found by an as-of join."""
    return f"""bs AS (SELECT scope, concat_ws(':', workload_family, scenario_id) AS stratum, count(*) AS runs,
      count(*) FILTER (positive) AS hit FROM sd WHERE attack_like AND known AND {condition} GROUP BY ALL),
  bw AS (SELECT scope, stratum, j, CASE WHEN hit IN (0, runs) THEN (j = hit)::double ELSE exp(lgamma(runs + 1) - lgamma(j + 1)
      - lgamma(runs - j + 1) + j * ln(nullif(hit, 0) / runs) + (runs - j) * ln(nullif(1 - hit / runs, 0))) END AS w
    FROM (SELECT *, unnest(range(0, runs + 1)) AS j FROM bs)),
  bc AS (SELECT scope, stratum, j, coalesce(sum(w) OVER (PARTITION BY scope, stratum ORDER BY j
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bw WHERE w > 0),
  bd AS (SELECT scope, stratum, runs, b, ('0x' || substr(md5('{config.BOOTSTRAP_SEED}:' || stratum || ':' || b), 1, 13))::ubigint
      / 4503599627370496.0 AS u FROM bs, range(0, {config.BOOTSTRAP_RESAMPLES}) r(b)),
  bm AS (SELECT bd.scope, b, sum(j) / sum(runs) AS mean FROM bd ASOF JOIN bc ON bd.scope = bc.scope AND bd.stratum = bc.stratum
    AND bd.u >= bc.before GROUP BY ALL),
  bi AS (SELECT scope, list_sort(list(mean))[{int(0.025 * config.BOOTSTRAP_RESAMPLES) + 1}] AS lower,
    list_sort(list(mean))[{int(0.975 * config.BOOTSTRAP_RESAMPLES) + 1}] AS upper FROM bm GROUP BY ALL)"""


@query(
    "eva6_contrast_decision",
    trial_check(TESTS, bootstrap_sql("split = 'test'"), select="""SELECT contrast, round(red, 9) AS relative_reduction, coalesce(red >= 0.25, false) AS material,
      adj < 0.05 AS significant, degeneracy = 'informative' AND coalesce(red >= 0.25, false) AND adj < 0.05 AND ni AS supported,
      CASE WHEN degeneracy <> 'informative' THEN 'uninformative' WHEN NOT coalesce(red >= 0.25, false)
        THEN 'reduction_too_small' WHEN adj >= 0.05 THEN 'not_significant' WHEN NOT ni THEN 'recall_inferior'
        ELSE 'supported' END AS reason, round(lower, 9) AS recall_lower, ni AS non_inferior
    FROM (SELECT hm.*, CASE WHEN fb > 0 THEN (fb - fa) / fb END AS red, lower, coalesce(lower >= rb - 0.05, false) AS ni
      FROM hm JOIN arms USING (contrast)
      JOIN (SELECT scope AS sa, false_positives / nullif(benign_runs, 0) AS fa FROM oc) x ON sa = arms.a
      JOIN (SELECT scope AS sb, false_positives / nullif(benign_runs, 0) AS fb,
        coalesce(true_positives / nullif(scenario_runs, 0), 0) AS rb FROM oc) y ON sb = arms.b
      LEFT JOIN bi ON bi.scope = arms.a)"""),
)
def contrast_decision(t: Tables) -> DataFrame:
    """The coarser arm is compared with the context arm; recall by the lower bootstrap bound."""
    calls = materialize(scored(t))
    outcomes = evaluate.scope_outcomes(calls)
    tested = evaluate.degeneracy(evaluate.mcnemar(evaluate.paired_calls(calls, CONTRASTS)))
    adjusted = evaluate.holm(tested.withColumn("family", F.lit("primary")))
    fpr = F.when(F.col("benign_runs") > 0, F.col("false_positives") / F.col("benign_runs"))
    arms = t.spark.createDataFrame(CONTRASTS, "contrast string, fine string, coarse string")
    fine = outcomes.select(F.col("scope").alias("fine"), fpr.alias("fpr_b"))
    coarse = outcomes.select(F.col("scope").alias("coarse"), fpr.alias("fpr_a"))
    rows = adjusted.join(arms, "contrast").join(fine, "fine").join(coarse, "coarse")
    rows = rows.join(evaluate.recall_not_inferior(calls, arms), "contrast")
    names = ["contrast", "material", "significant", "supported", "reason", "non_inferior"]
    return evaluate.decide_contrasts(rows).select(*names, r9("relative_reduction"), r9("recall_lower"))


@query(
    "eva5_bootstrap_recall",
    trial_check(bootstrap_sql("scope = 'ARM-CONTEXT'"), select="""SELECT sum(runs)::bigint AS runs, sum(hit) / sum(runs) AS point_estimate,
      any_value(lower) AS lower, any_value(upper) AS upper, any_value(lower) >= 1.0 - 0.05 AS non_inferior
      FROM bs JOIN bi USING (scope) HAVING count(*) > 0"""),
)
def bootstrap_recall(t: Tables) -> DataFrame:
    strata = evaluate.recall_strata(scored(t)).where("scope = 'ARM-CONTEXT'")
    return evaluate.bootstrap_recall(strata, 1.0)


@query(
    "eva1_split_isolation",
    """WITH r AS (SELECT 'c' || (o_custkey % 900) AS container_id, 'trial-' || o_custkey AS trial_id FROM orders),
      s AS (SELECT container_id, """ + SPLIT.format("trial_id") + """ AS split FROM r)
    SELECT container_id, count(DISTINCT split) AS splits, count(*) AS trials FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def split_isolation(t: Tables) -> DataFrame:
    key = F.col("o_custkey")
    rows = t.raw("orders").select(
        F.concat(F.lit("c"), (key % 900).cast("string")).alias("container_id"),
        F.concat(F.lit("trial-"), key.cast("string")).alias("trial_id"),
    )
    return evaluate.split_leaks(evaluate.split_trials(rows))


CONTEXTS = """ct AS (SELECT tr.*, u % 4 = 0 AS priv, CASE WHEN u % 3 = 0 THEN '["NET_RAW"]' ELSE '[]' END AS caps, u % 2 = 0 AS ro,
    CASE WHEN u % 9 = 0 THEN 'host' ELSE 'bridge' END AS net, u % 6 AS mnt, CASE WHEN u % 10 > 0 THEN u % 5 END AS dev FROM tr
    WHERE NOT attack_like),
  rf AS (SELECT image_digest, priv, caps, ro, net, mnt, dev, context_variant AS rv FROM ct WHERE split = 'fit'
    QUALIFY row_number() OVER (PARTITION BY image_digest ORDER BY trial_id) = 1),
  cd AS (SELECT ct.trial_id, ct.image_digest, ct.context_variant, ct.split, rv, rf.rv IS NOT NULL AS known,
    round(0.35 * (ct.priv IS DISTINCT FROM rf.priv)::int + 0.3 * (ct.caps IS DISTINCT FROM rf.caps)::int
      + 0.15 * (ct.ro IS DISTINCT FROM rf.ro)::int + 0.1 * (ct.net IS DISTINCT FROM rf.net)::int
      + 0.05 * (ct.mnt IS DISTINCT FROM rf.mnt)::int + 0.05 * (ct.dev IS DISTINCT FROM rf.dev)::int, 6) AS delta,
    concat_ws(',', CASE WHEN ct.priv IS DISTINCT FROM rf.priv THEN 'privileged' END,
      CASE WHEN ct.caps IS DISTINCT FROM rf.caps THEN 'capabilities' END,
      CASE WHEN ct.ro IS DISTINCT FROM rf.ro THEN 'read_only_rootfs' END,
      CASE WHEN ct.net IS DISTINCT FROM rf.net THEN 'network_mode' END,
      CASE WHEN ct.mnt IS DISTINCT FROM rf.mnt THEN 'mounts' END,
      CASE WHEN ct.dev IS DISTINCT FROM rf.dev THEN 'devices' END) AS fields
    FROM ct LEFT JOIN rf USING (image_digest))"""


def context_trials(t: Tables) -> DataFrame:
    u = F.col("u")
    context = F.struct(
        (u % 4 == 0).alias("privileged"),
        F.when(u % 3 == 0, F.array(F.lit("NET_RAW"))).otherwise(F.array().cast("array<string>")).alias("capabilities"),
        (u % 2 == 0).alias("read_only_rootfs"),
        F.when(u % 9 == 0, "host").otherwise("bridge").alias("network_mode"),
        (u % 6).alias("mounts"),
        F.when(u % 10 > 0, u % 5).alias("devices"),
    )
    return trials(t).withColumn("context", context)


@query(
    "sco15_context_delta",
    trial_check(CONTEXTS, select="""SELECT trial_id, CASE WHEN known THEN cast(delta AS double) END AS delta_score,
      CASE WHEN known THEN fields END AS differing_fields FROM cd"""),
)
def context_delta(t: Tables) -> DataFrame:
    rows = evaluate.context_delta_trials(context_trials(t))
    return rows.select("trial_id", "delta_score", F.array_join("differing_fields", ",").alias("differing_fields"))


@query(
    "eva10_context_delta_by_variant",
    trial_check(CONTEXTS, select="""SELECT context_variant, count(*) AS trials, count(*) FILTER (delta > 0) AS positives
      FROM cd WHERE split = 'test' AND known GROUP BY ALL"""),
)
def context_delta_by_variant(t: Tables) -> DataFrame:
    return evaluate.context_delta_by_variant(evaluate.context_delta_trials(context_trials(t)))


@query(
    "eva10_context_delta_coverage",
    trial_check(CONTEXTS, select="""SELECT trial_id, status, CASE WHEN status = 'scored' THEN round((1 + above) / (n + 1), 9) END AS p_value
    FROM (SELECT c.trial_id, CASE WHEN NOT c.known THEN 'insufficient_profile' WHEN c.context_variant <> c.rv
        THEN 'drift_detected' ELSE 'scored' END AS status, count(f.delta) AS n, count(*) FILTER (f.delta >= c.delta) AS above
      FROM cd c LEFT JOIN cd f ON f.image_digest = c.image_digest AND f.split = 'fit' AND f.known
      WHERE c.split = 'calibration' GROUP BY ALL)"""),
)
def context_delta_coverage(t: Tables) -> DataFrame:
    rows = evaluate.context_delta_coverage(evaluate.context_delta_trials(context_trials(t)))
    return rows.select("trial_id", "status", r9("p_value"))


# --- boundaries and records --------------------------------------------------------------

BOUNDARY = """gen AS (SELECT 'trial-' || u AS trial_id, n AS sequence FROM ex),
  obs AS (SELECT trial_id, 'source' AS boundary, sequence FROM gen WHERE sequence % 17 <> 0
    UNION ALL SELECT trial_id, 'database', sequence FROM gen WHERE sequence % 23 <> 0
    UNION ALL SELECT trial_id, 'database', sequence FROM gen WHERE sequence % 31 = 0 AND sequence % 23 <> 0
    UNION ALL SELECT trial_id, 'database', sequence + 1000000000 FROM gen WHERE sequence % 101 = 0),
  bd AS (SELECT DISTINCT trial_id, b AS boundary, b <> 'spool' AS measured FROM gen, (VALUES ('source'), ('database'), ('spool')) v(b)),
  so AS (SELECT trial_id, boundary, sequence, count(*) AS c FROM obs GROUP BY ALL),
  rec AS (SELECT bd.trial_id, bd.boundary, CASE WHEN measured THEN 'measured' ELSE 'unmeasured' END AS status,
      (SELECT count(DISTINCT sequence) FROM gen WHERE gen.trial_id = bd.trial_id) AS generated,
      CASE WHEN measured THEN (SELECT count(*) FROM so WHERE so.trial_id = bd.trial_id AND so.boundary = bd.boundary) END AS observed,
      CASE WHEN measured THEN (SELECT count(*) FROM so WHERE so.trial_id = bd.trial_id AND so.boundary = bd.boundary
        AND sequence >= 1000000000) END AS unexpected,
      CASE WHEN measured THEN (SELECT cast(coalesce(sum(c - 1), 0) AS bigint) FROM so WHERE so.trial_id = bd.trial_id
        AND so.boundary = bd.boundary) END AS duplicates FROM bd)"""


def boundary_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    made = t.execs.select(
        F.concat(F.lit("trial-"), F.col("u").cast("string")).alias("trial_id"), F.col("n").alias("sequence")
    )
    n = F.col("sequence")

    def at(boundary: str, rows: DataFrame) -> DataFrame:
        return rows.select("trial_id", F.lit(boundary).alias("boundary"), "sequence")

    stored = made.where(n % 23 != 0)
    observed = (
        at("source", made.where(n % 17 != 0))
        .unionByName(at("database", stored))
        .unionByName(at("database", stored.where(n % 31 == 0)))
        .unionByName(at("database", made.where(n % 101 == 0).withColumn("sequence", n + 1_000_000_000)))
    )
    names = F.explode(F.array(*[F.lit(b) for b in ("source", "database", "spool")]))
    boundaries = made.select("trial_id").distinct().select("trial_id", names.alias("boundary"))
    return made, observed, boundaries.withColumn("measured", F.col("boundary") != "spool")


@query(
    "eva12_boundary_reconciliation",
    duck_prefix("ex") + "," + BOUNDARY + """ SELECT *, CASE WHEN status = 'measured' THEN generated - (observed - unexpected) END AS missing,
      CASE WHEN status = 'measured' THEN round((generated - (observed - unexpected)) / generated, 9) END AS loss_fraction FROM rec""",
)
def boundary_reconciliation(t: Tables) -> DataFrame:
    return evaluate.reconcile_boundaries(*boundary_inputs(t)).withColumn("loss_fraction", r9("loss_fraction"))


@query(
    "eva12_missing_sequences",
    duck_prefix("ex") + "," + BOUNDARY + """ SELECT trial_id, 'source' AS boundary, sequence FROM gen WHERE sequence % 17 = 0
      UNION ALL SELECT trial_id, 'database', sequence FROM gen WHERE sequence % 23 = 0""",
)
def missing_sequences(t: Tables) -> DataFrame:
    return evaluate.missing_sequences(*boundary_inputs(t)).select("trial_id", "boundary", "sequence")


@query(
    "eva13_marker_extraction",
    duck_prefix("ex") + """ SELECT container_id, count(DISTINCT s) AS sequences, count(*) - count(DISTINCT s) AS duplicates FROM (
      SELECT DISTINCT container_id, event_id, regexp_extract(command_line, '--id=(\\d+)', 1) AS s FROM ex)
      WHERE s <> '' GROUP BY ALL""",
)
def marker_extraction(t: Tables) -> DataFrame:
    return evaluate.marker_summary(evaluate.extract_markers(t.execs, r"--id=(\d+)"))


@query(
    "agg20_trial_metrics",
    duck_prefix("ex") + """ SELECT container_id, round(quantile_disc(v, 0.5), 4) AS p50, round(quantile_disc(v, 0.95), 4) AS p95,
      round(quantile_disc(v, 0.99), 4) AS p99, count(*) AS samples FROM ex GROUP BY ALL""",
)
def trial_metrics(t: Tables) -> DataFrame:
    return evaluate.load_percentiles(t.execs, ["container_id"], "v")


@query(
    "agg21_run_totals",
    duck_prefix("ex", "trial") + "," + BOUNDARY + """ SELECT (SELECT count(DISTINCT workload_id) FROM trial) AS runs,
      (SELECT count(*) FROM trial) AS trials, (SELECT count(*) FROM trial WHERE status = 'completed') AS completed,
      (SELECT cast(sum(generated) AS bigint) FROM rec WHERE boundary = 'source') AS generated,
      (SELECT cast(sum(observed) AS bigint) FROM rec WHERE boundary = 'source') AS at_source,
      (SELECT cast(sum(observed) AS bigint) FROM rec WHERE boundary = 'database') AS stored""",
)
def run_totals(t: Tables) -> DataFrame:
    rows = evaluate.reconcile_boundaries(*boundary_inputs(t))
    return evaluate.run_totals(t.trials.withColumn("run_id", F.col("workload_id")), rows)


@query(
    "eva15_structural_validation",
    """WITH r AS (SELECT 'T' || (o_orderkey % 14000) AS trial_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed'
        ELSE 'running' END AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS failure_reason,
        CASE WHEN o_orderkey % 5 = 0 THEN 'img:latest' WHEN o_orderkey % 5 > 1 THEN 'img@sha256:' || o_orderkey END AS ref FROM orders)
    SELECT trial_id, 'no_terminal_status' AS violation FROM r WHERE status = 'running'
    UNION ALL SELECT trial_id, 'failed_without_reason' FROM r WHERE status = 'failed' AND failure_reason IS NULL
    UNION ALL SELECT trial_id, 'digest_not_pinned' FROM r WHERE status = 'completed' AND NOT coalesce(contains(ref, '@sha256:'), false)
    UNION ALL SELECT trial_id, 'duplicate_trial_id' FROM r GROUP BY trial_id HAVING count(*) > 1""",
)
def structural_validation(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed")
    rows = t.raw("orders").select(
        F.concat(F.lit("T"), (key % 14000).cast("string")).alias("trial_id"),
        status.otherwise("running").alias("status"),
        F.when(key % 3 > 0, F.col("o_orderpriority")).alias("failure_reason"),
        F.when(key % 5 == 0, "img:latest")
        .when(key % 5 > 1, F.concat(F.lit("img@sha256:"), key.cast("string")))
        .alias("image_reference"),
    )
    return evaluate.structural_violations(rows)


PLAN = """pl AS (SELECT 'benign' AS cell_kind, 'W' || w AS workload_id, 'mode' || m AS item, 4 AS minimum
    FROM (SELECT DISTINCT n_nationkey % 5 AS w FROM nation), (SELECT DISTINCT r_regionkey % 4 AS m FROM region)
  UNION ALL SELECT 'scenario', 'W' || w, 'SCN-' || s, 2
    FROM (SELECT DISTINCT n_nationkey % 5 AS w FROM nation), (SELECT DISTINCT r_regionkey % 3 AS s FROM region)),
  cell AS (SELECT 'benign' AS cell_kind, workload_id, mode AS item, count(*) AS found FROM tr WHERE NOT attack_like GROUP BY ALL
    UNION ALL SELECT 'scenario', workload_id, scenario_id, count(*) FROM tr WHERE scenario_id IS NOT NULL GROUP BY ALL)"""


def plan(t: Tables) -> DataFrame:
    versions = t.raw("nation").select((F.col("n_nationkey") % 5).cast("string").alias("w")).distinct()

    def cells(kind: str, items: list[str], minimum: int) -> DataFrame:
        return versions.select(
            F.lit(kind).alias("cell_kind"),
            F.concat(F.lit("W"), "w").alias("workload_id"),
            F.explode(F.array(*[F.lit(i) for i in items])).alias("item"),
            F.lit(minimum).alias("minimum"),
        )

    return cells("benign", ["mode0", "mode1", "mode2", "mode3"], 4).unionByName(
        cells("scenario", ["SCN-0", "SCN-1", "SCN-2"], 2)
    )


@query(
    "jn13_plan_coverage",
    trial_check(PLAN, select="""SELECT cell_kind, workload_id, item, coalesce(found, 0) AS found,
      coalesce(found, 0) >= minimum AS satisfied FROM pl LEFT JOIN cell USING (cell_kind, workload_id, item)"""),
)
def plan_coverage(t: Tables) -> DataFrame:
    return evaluate.plan_cells(plan(t), trials(t)).drop("minimum")


@query(
    "agg23_group_coverage",
    trial_check(select="""SELECT workload_id, context_variant, split, count(DISTINCT replica_index) AS replicas,
      count(*) FILTER (NOT attack_like) AS clean_runs FROM tr GROUP BY ALL"""),
)
def group_coverage(t: Tables) -> DataFrame:
    return evaluate.group_coverage(trials(t))


@query(
    "eva14_plan_conformance",
    trial_check(PLAN, select="""SELECT 'scenario_present' AS check_id, item AS subject, (SELECT count(*) FROM tr WHERE scenario_id = item) AS found,
        1::bigint AS required, (SELECT count(*) FROM tr WHERE scenario_id = item) >= 1 AS satisfied
      FROM (SELECT DISTINCT item FROM pl WHERE cell_kind = 'scenario')
    UNION ALL SELECT 'scenario_exploratory', scenario_id, count(*), 0, true FROM tr WHERE scenario_id NOT IN ('SCN-0', 'SCN-1') GROUP BY 2
    UNION ALL SELECT 'version_present', workload_id, (SELECT count(*) FROM tr WHERE tr.workload_id = p.workload_id), 1,
        (SELECT count(*) FROM tr WHERE tr.workload_id = p.workload_id) >= 1 FROM (SELECT DISTINCT workload_id FROM pl) p
    UNION ALL SELECT 'mode_present', workload_id || '|' || item, (SELECT count(*) FROM tr WHERE tr.workload_id = p.workload_id
        AND mode = item), 1, (SELECT count(*) FROM tr WHERE tr.workload_id = p.workload_id AND mode = item) >= 1
      FROM pl p WHERE cell_kind = 'benign'
    UNION ALL SELECT 'hard_negative_present', f || '|' || h, (SELECT count(*) FROM tr WHERE workload_family = f AND hard_negative_id = h), 1,
        (SELECT count(*) FROM tr WHERE workload_family = f AND hard_negative_id = h) >= 1
      FROM (VALUES ('F0', 'H0'), ('F0', 'H1'), ('F1', 'H1')) v(f, h)
    UNION ALL SELECT 'ground_truth_present', 'all', (SELECT count(*) FROM tr WHERE u % 41 = 0), 0,
        (SELECT count(*) FROM tr WHERE u % 41 = 0) = 0
    UNION ALL SELECT 'replicas_per_split', workload_id || '|' || s, (SELECT count(DISTINCT replica_index) FROM tr
        WHERE tr.workload_id = p.workload_id AND split = s), 3, (SELECT count(DISTINCT replica_index) FROM tr
        WHERE tr.workload_id = p.workload_id AND split = s) >= 3
      FROM (SELECT DISTINCT workload_id FROM pl) p, (VALUES ('fit'), ('calibration'), ('test')) v(s)
    UNION ALL SELECT 'clean_runs_per_stratum', workload_id || '|' || context_variant, least(count(*) FILTER (split = 'fit'),
        count(*) FILTER (split = 'calibration')), 10, least(count(*) FILTER (split = 'fit'),
        count(*) FILTER (split = 'calibration')) >= 10
      FROM tr WHERE NOT attack_like AND split IN ('fit', 'calibration') GROUP BY workload_id, context_variant
    UNION ALL SELECT 'cell_count', cell_kind || '|' || workload_id || '|' || item, coalesce(found, 0), minimum,
        coalesce(found, 0) >= minimum FROM pl LEFT JOIN cell USING (cell_kind, workload_id, item)"""),
)
def plan_conformance(t: Tables) -> DataFrame:
    outcome = F.when(F.col("u") % 41 != 0, F.when(F.col("attack_like"), "attack").otherwise("benign"))
    rows = trials(t).withColumn("expected_outcome", outcome)
    hard = t.spark.createDataFrame(
        [("F0", "H0"), ("F0", "H1"), ("F1", "H1")], "workload_family string, hard_negative_id string"
    )
    known = t.spark.createDataFrame([("SCN-0",), ("SCN-1",)], "scenario_id string")
    return evaluate.conformance(plan(t), rows, hard, known)


@query(
    "eva16_pilot_inputs",
    trial_check(TESTS, select="""SELECT contrast, cast(only_a + only_b AS bigint) AS discordant, n_pairs AS pairs,
      round(false_positives / nullif(benign_runs, 0), 9) AS baseline_fpr,
      coalesce(false_positives > 0 AND false_positives < benign_runs, false) AS usable
    FROM arms LEFT JOIN mc USING (contrast) LEFT JOIN oc ON oc.scope = arms.b"""),
)
def pilot_inputs(t: Tables) -> DataFrame:
    calls = scored(t)
    tested = evaluate.mcnemar(evaluate.paired_calls(calls, CONTRASTS))
    out = evaluate.pilot_inputs(tested, evaluate.scope_outcomes(calls), CONTRASTS)
    return out.withColumn("baseline_fpr", r9("baseline_fpr"))


TAG_DRIFT = """dg AS (SELECT DISTINCT human_tag, image_digest AS d FROM tr),
  f AS (SELECT human_tag, min(d) AS d0 FROM dg GROUP BY 1 HAVING count(*) > 1),
  pr AS (SELECT human_tag, d0, d FROM f JOIN dg USING (human_tag) WHERE d <> d0),
  rd AS (SELECT ref, token, n, t FROM refs JOIN rt USING (scope, ref) WHERE scope = 'ARM-DIGEST'),
  xa AS (SELECT human_tag, d, token, n / t AS p FROM pr JOIN rd ON ref = d0),
  xb AS (SELECT human_tag, d, token, n / t AS q FROM pr JOIN rd ON ref = d),
  xs AS (SELECT human_tag, d, round(sqrt(greatest(0.0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END)
      + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END))), 9) AS js
    FROM (SELECT human_tag, d, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM xa FULL JOIN xb USING (human_tag, d, token))
    GROUP BY ALL HAVING sum(p) > 0 AND sum(q) > 0)"""


@query(
    "eva17_tag_drift",
    trial_check(TAG_DRIFT, select="""SELECT human_tag, d AS digest, js AS js_distance, js IS NOT NULL AS has_references
      FROM pr LEFT JOIN xs USING (human_tag, d)"""),
)
def tag_drift(t: Tables) -> DataFrame:
    rows = trials(t)
    references = evaluate.scope_references(evaluate.scope_keys(rows), trial_tokens(t))
    return evaluate.tag_drift(references, rows).withColumn("js_distance", r9("js_distance"))


@query(
    "eva18_outcome_metrics",
    trial_check(select="""SELECT scope, round(count(*) FILTER (known AND attack_like AND positive)
        / nullif(count(*) FILTER (known AND positive), 0), 9) AS precision,
      round(count(*) FILTER (NOT known) / count(*), 9) AS insufficient_fraction FROM sd WHERE split = 'test' GROUP BY ALL"""),
)
def outcome_metrics(t: Tables) -> DataFrame:
    out = evaluate.outcome_metrics(scored(t), ["scope"])
    return out.select("scope", r9("precision"), r9("insufficient_fraction"))


@query(
    "eva18_time_to_evidence",
    duck_prefix("ex", "lc") + """, a AS (SELECT container_id, min(us) AS action_us FROM lc WHERE privileged GROUP BY 1)
    SELECT container_id, action_us, round((first_us - action_us) / 1e6, 6) AS seconds_to_evidence FROM (
      SELECT container_id, action_us, min(us) FILTER (us >= action_us) AS first_us
      FROM a LEFT JOIN (SELECT container_id, us FROM ex WHERE process_name = 'sh') USING (container_id) GROUP BY ALL)""",
)
def time_to_evidence(t: Tables) -> DataFrame:
    actions = t.lifecycle.where("privileged").groupBy("container_id").agg(F.min("us").alias("action_us"))
    evidence = t.execs.where("process_name = 'sh'").select("container_id", F.col("us").alias("evidence_us"))
    out = evaluate.first_evidence(actions, evidence, ["container_id"])
    return out.withColumn("seconds_to_evidence", F.round("seconds_to_evidence", 6))


@query(
    "eva18_persistence_latency",
    duck_prefix("lc") + """ SELECT action, round(quantile_disc(d, 0.5), 4) AS p50, round(quantile_disc(d, 0.95), 4) AS p95,
      round(quantile_disc(d, 0.99), 4) AS p99, count(*) AS samples
    FROM (SELECT action, (received_us - us) / 1e6 AS d FROM lc) GROUP BY ALL""",
)
def persistence_latency(t: Tables) -> DataFrame:
    return evaluate.persistence_latency(t.lifecycle, ["action"])


@query(
    "eva19_multiset_diff",
    duck_prefix("ex") + """, c AS (SELECT 'v' || (u % 3) AS variant, process_name, executable, count(*) AS n FROM ex GROUP BY ALL),
      x AS (SELECT v.variant, b.process_name, b.executable, b.n AS b, 0 AS n FROM c b, (VALUES ('v1'), ('v2')) v(variant)
          WHERE b.variant = 'v0'
        UNION ALL SELECT variant, process_name, executable, 0, n FROM c WHERE variant <> 'v0')
    SELECT variant, process_name, executable, cast(greatest(sum(n) - sum(b), 0) AS bigint) AS added,
      cast(greatest(sum(b) - sum(n), 0) AS bigint) AS removed FROM x GROUP BY ALL HAVING sum(n) <> sum(b)""",
)
def multiset_diff(t: Tables) -> DataFrame:
    variant = F.concat(F.lit("v"), (F.col("u") % 3).cast("string"))
    rows = t.execs.select(variant.alias("variant"), "process_name", "executable")
    return evaluate.multiset_diff(rows, "variant", "v0", ["v1", "v2"], ["process_name", "executable"])
