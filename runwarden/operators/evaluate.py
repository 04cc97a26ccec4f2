"""Evaluation of detectors over labelled trials.

trials   trial_id, container_id, human_tag, image_digest, context_hash, attack_like,
         status and further labels; one row per trial
tokens   trial_id, token, n: what each trial ran
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden import config
from runwarden.functions.hashing import assign_split
from runwarden.functions.stats import clopper_pearson, mcnemar_p
from runwarden.operators.ordering import Ordered
from runwarden.operators.quantiles import exact_quantiles
from runwarden.operators.rarity import empirical_pvalues
from runwarden.operators.score import compare_tokens
from runwarden.session import materialize


def split_trials(trials: DataFrame) -> DataFrame:
    return trials.withColumn("split", assign_split(F.col("trial_id")))


def split_leaks(trials: DataFrame) -> DataFrame:
    """Containers that appear in more than one split."""
    return (
        trials.groupBy("container_id")
        .agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("trials"))
        .where("splits > 1")
    )


def scope_keys(rows: DataFrame) -> DataFrame:
    """Four rows per trial: the reference group it belongs to under each scope."""
    context = F.concat_ws("::", "image_digest", "context_hash")
    keys = [F.lit("global"), F.col("human_tag"), F.col("image_digest"), context]
    pairs = [
        F.struct(F.lit(scope).alias("scope"), key.alias("reference_key"))
        for scope, key in zip(config.SCOPES, keys)
    ]
    return rows.select("*", F.inline(F.array(*pairs)))


def scope_references(scoped: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pooled token counts of the benign fit trials per (scope, reference key).

    The tokens of a trial are counted before this, so the global scope pools trial
    totals and not events.
    """
    fit = scoped.where("split = 'fit' AND NOT attack_like")
    rows = fit.select("trial_id", "scope", "reference_key").join(tokens, "trial_id")
    return rows.groupBy("scope", "reference_key", "token").agg(F.sum("n").alias("n"))


def scope_distances(
    scoped: DataFrame,
    tokens: DataFrame,
    references: DataFrame,
    threshold: float = config.DISTANCE_THRESHOLD,
) -> DataFrame:
    """Distance and call of every trial under every scope.

    Trials without a reference are kept and say ``insufficient_profile``.
    """
    keys = ["scope", "reference_key"]
    observed = scoped.select(*keys, "trial_id").join(tokens, "trial_id")
    distances = compare_tokens(references, observed, keys, [*keys, "trial_id"])
    present = references.select(*keys).distinct().withColumn("_reference", F.lit(True))
    joined = scoped.join(distances.select(*keys, "trial_id", "js_distance"), [*keys, "trial_id"], "left")
    joined = joined.join(present, keys, "left")
    known = F.col("_reference").isNotNull()
    distance = F.when(known, F.col("js_distance"))
    return joined.withColumns(
        {
            "has_reference": known,
            "js_distance": distance,
            "positive": F.coalesce(distance >= threshold, F.lit(False)),
            "outcome": F.when(known, "scored").otherwise("insufficient_profile"),
        }
    ).drop("_reference")


def scope_outcomes(scored: DataFrame) -> DataFrame:
    """Counts per scope over the test trials."""
    known, attack, positive = F.col("has_reference"), F.col("attack_like"), F.col("positive")
    return scored.where("split = 'test'").groupBy("scope").agg(
        F.count_if(known & ~attack).alias("benign_runs"),
        F.count_if(known & ~attack & positive).alias("false_positives"),
        F.count_if(known & attack).alias("scenario_runs"),
        F.count_if(known & attack & positive).alias("true_positives"),
        F.count_if(~known).alias("insufficient_profile_runs"),
    )


def with_interval(rows: DataFrame, successes: str, trials: str, alias: str, confidence: float = 0.95) -> DataFrame:
    """Add point estimate and exact interval of a proportion to grouped counts."""
    interval = clopper_pearson(confidence)(F.col(successes), F.col(trials))
    point = F.when(F.col(trials) > 0, F.col(successes) / F.col(trials))
    return rows.withColumn(alias, F.struct(point.alias("point"), interval.alias("interval"))).select(
        *rows.columns,
        F.col(f"{alias}.point").alias(f"{alias}_point"),
        F.col(f"{alias}.interval.lower").alias(f"{alias}_lower"),
        F.col(f"{alias}.interval.upper").alias(f"{alias}_upper"),
    )


# --- calibration coverage ----------------------------------------------------------------


def calibration_rows(scored: DataFrame, alpha: float = config.COVERAGE_ALPHA) -> DataFrame:
    """p-value of every benign calibration trial against the fit trials of its reference.

    A trial whose (digest, context) took no part in the fit is drift: it keeps its
    distance, gets no p-value and stays in the denominator.
    """
    keys = ["scope", "reference_key"]
    benign = scored.where("NOT attack_like")
    fit = benign.where("split = 'fit' AND has_reference AND js_distance IS NOT NULL")
    trained = (
        benign.where("split = 'fit'")
        .select(*keys, "image_digest", "context_hash")
        .distinct()
        .withColumn("_trained", F.lit(True))
    )
    held_out = benign.where("split = 'calibration'").join(
        trained, [*keys, "image_digest", "context_hash"], "left"
    )
    values = fit.select(*keys, F.col("js_distance").alias("value"))
    ranked = empirical_pvalues(values, held_out.withColumn("value", F.col("js_distance")).drop("status"), keys)
    known, same = F.col("has_reference"), F.col("_trained").isNotNull()
    status = (
        F.when(~known, "insufficient_profile").when(~same, "drift_detected").otherwise("scored")
    )
    p = F.when(known & same, F.col("p_value"))
    return ranked.select(
        "trial_id",
        *keys,
        "js_distance",
        status.alias("status"),
        p.alias("p_value"),
        F.coalesce(p > alpha, F.lit(False)).alias("covered"),
    )


def coverage_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("calibration_trials"),
        F.count_if("covered").alias("covered"),
        F.count_if(F.col("status") == "drift_detected").alias("drift_detected_runs"),
        F.count_if(F.col("status") == "insufficient_profile").alias("insufficient_profile_runs"),
    )


# --- contrasts ---------------------------------------------------------------------------


def paired_calls(scored: DataFrame, contrasts: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(contrast, trial_id, a, b): calls of the same benign test trial under two arms."""
    usable = scored.where("split = 'test' AND NOT attack_like AND has_reference")
    by_arm = usable.groupBy("trial_id").agg(
        *[
            F.max(F.when(F.col("scope") == arm, F.col("positive"))).alias(arm)
            for arm in sorted({a for _, *arms in contrasts for a in arms})
        ]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("contrast"), F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"))
            for name, a, b in contrasts
        ]
    )
    rows = by_arm.select("trial_id", F.inline(pairs))
    return rows.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Exact McNemar test and degeneracy flags per contrast."""
    a, b = F.col("a"), F.col("b")
    counts = pairs.groupBy("contrast").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(a & ~b).alias("only_a"),
        F.count_if(b & ~a).alias("only_b"),
        F.count_if(a).alias("a_positives"),
        F.count_if(b).alias("b_positives"),
    )
    return counts.withColumn("p_value", mcnemar_p(F.col("only_a"), F.col("only_b")))


def degeneracy(tested: DataFrame) -> DataFrame:
    """Contrasts in which an arm never varies or the arms always agree say nothing."""

    def constant(positives: str) -> Column:
        return (F.col(positives) == 0) | (F.col(positives) == F.col("n_pairs"))

    agree = (F.col("only_a") + F.col("only_b")) == 0
    reason = (
        F.when(constant("a_positives"), "arm_a_constant")
        .when(constant("b_positives"), "arm_b_constant")
        .when(agree, "no_discordant_pairs")
        .otherwise("informative")
    )
    return tested.withColumn("degeneracy", reason).withColumn(
        "informative", F.col("degeneracy") == "informative"
    )


def holm(tests: DataFrame, family: str = "family", name: str = "contrast", alpha: float = config.FAMILY_ALPHA) -> DataFrame:
    """Holm step-down adjustment within each family of tests.

    Families are cut into chunks of close p-values, so one family may hold all tests.  The tests
    are written once, as rows and carries read them.
    """
    ranked = Ordered(materialize(tests), [family], ["p_value", name]).number("_rank").total("_size", F.lit(1).cast("bigint"))
    step = F.least(F.lit(1.0), F.col("p_value") * (F.col("_size") - F.col("_rank") + 1))
    adjusted = ranked.with_column("_step", step).running_max("_step", "adjusted_p").rows
    return adjusted.withColumn("rejected", F.col("adjusted_p") < alpha).drop("_step", "_rank", "_size")


def decide_contrasts(rows: DataFrame) -> DataFrame:
    """Verdict per contrast.

    rows: contrast, fpr_a, fpr_b, adjusted_p, non_inferior, informative.
    """
    reduction = F.when(F.col("fpr_a") > 0, (F.col("fpr_a") - F.col("fpr_b")) / F.col("fpr_a"))
    material = F.coalesce(reduction >= config.MATERIAL_REDUCTION, F.lit(False))
    significant = F.coalesce(F.col("adjusted_p") < config.FAMILY_ALPHA, F.lit(False))
    supported = material & significant & F.col("non_inferior") & F.col("informative")
    reason = (
        F.when(~F.col("informative"), "uninformative")
        .when(~material, "reduction_too_small")
        .when(~significant, "not_significant")
        .when(~F.col("non_inferior"), "recall_inferior")
        .otherwise("supported")
    )
    return rows.withColumns(
        {
            "relative_reduction": reduction,
            "material": material,
            "significant": significant,
            "supported": supported,
            "reason": reason,
        }
    )


def _binomial_hits(runs: int, detected: int, uniforms):
    """Number of hits at each uniform, by the distribution function of binomial(runs, detected / runs).

    Only counts within 40 standard deviations of the mean are built; what is beyond has no weight
    in a double.  Memory grows with the root of ``runs``.
    """
    import numpy as np

    if detected in (0, runs):
        return np.full(len(uniforms), detected, dtype=np.int64)
    reach = int(40 * math.sqrt(detected * (runs - detected) / runs)) + 40
    low, high = max(0, detected - reach), min(runs, detected + reach)
    odds = detected / (runs - detected)
    # Weights relative to the mean, which is the mode, outwards from it.
    up, down = np.arange(detected, high, dtype=float), np.arange(detected, low, -1, dtype=float)
    above = np.cumprod((runs - up) / (up + 1) * odds)
    below = np.cumprod(down / (runs - down + 1) / odds)
    reached = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return low + np.minimum(np.searchsorted(reached / reached[-1], uniforms, side="right"), high - low)


def bootstrap_interval(
    strata: DataFrame,
    by: Sequence[str] = (),
    resamples: int = config.BOOTSTRAP_RESAMPLES,
    seed: int = config.BOOTSTRAP_SEED,
) -> DataFrame:
    """Percentile interval of recall under stratified resampling, for each value of ``by``.

    strata: by columns, stratum, runs, detected.  Gives by columns, runs, point_estimate, lower,
    upper; strata without runs count for nothing, and without any there is no row.

    Drawing n outcomes with replacement from a stratum of 0/1 outcomes is one binomial draw,
    so the work is resamples x strata and not resamples x trials.  The draw is the binomial
    quantile of a hash of (seed, stratum, resample): the same on every run and in every language.
    """
    keys = ", ".join(f"`{n}` {kind}" for n, kind in strata.dtypes if n in by)

    def draw(batches):
        import hashlib

        import numpy as np
        import pandas as pd

        for batch in batches:
            for row in batch.to_dict("records"):
                texts = (f"{seed}:{row['stratum']}:{b}".encode() for b in range(resamples))
                uniforms = np.array([int(hashlib.md5(x).hexdigest()[:13], 16) for x in texts]) / 2.0**52
                hits = _binomial_hits(row["runs"], row["detected"], uniforms)
                held = {name: row[name] for name in by}
                yield pd.DataFrame({**held, "b": np.arange(resamples), "hits": hits, "runs": row["runs"]})

    usable = strata.where("runs > 0").select(*by, "stratum", "runs", "detected")
    drawn = usable.mapInPandas(draw, ", ".join([*([keys] if keys else []), "b bigint, hits bigint, runs bigint"]))
    means = drawn.groupBy(*by, "b").agg((F.sum("hits") / F.sum("runs")).alias("mean"))
    # One value per resample: the array has exactly ``resamples`` elements.
    bounds = means.groupBy(*by).agg(F.array_sort(F.collect_list("mean")).alias("means")).select(
        *by,
        F.element_at("means", int(0.025 * resamples) + 1).alias("lower"),
        F.element_at("means", min(resamples - 1, int(0.975 * resamples)) + 1).alias("upper"),
    )
    point = usable.groupBy(*by).agg(
        F.sum("runs").alias("runs"), (F.sum("detected") / F.sum("runs")).alias("point_estimate")
    )
    same = [F.col(f"p.{n}").eqNullSafe(F.col(f"q.{n}")) for n in by] or [F.lit(0) == F.lit(0)]
    both = point.alias("p").join(bounds.alias("q"), functools.reduce(Column.__and__, same))
    return both.select(*[F.col(f"p.{n}").alias(n) for n in by], "runs", "point_estimate", "lower", "upper").where("runs > 0")


def bootstrap_recall(
    strata: DataFrame,
    reference_recall: float,
    margin: float = config.RECALL_MARGIN,
    resamples: int = config.BOOTSTRAP_RESAMPLES,
    seed: int = config.BOOTSTRAP_SEED,
) -> DataFrame:
    """Interval of recall over all strata, and whether its lower bound stays within the margin."""
    out = bootstrap_interval(strata, (), resamples, seed)
    return out.withColumn("non_inferior", F.col("lower") >= reference_recall - margin)


def recall_strata(scored: DataFrame) -> DataFrame:
    """(scope, stratum, runs, detected) of the attack trials that have a reference."""
    rows = scored.where("attack_like AND has_reference")
    return rows.groupBy("scope", F.concat_ws(":", "workload_family", "scenario_id").alias("stratum")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("positive").alias("detected")
    )


def recall_not_inferior(scored: DataFrame, contrasts: DataFrame, margin: float = config.RECALL_MARGIN) -> DataFrame:
    """(contrast, recall_lower, non_inferior): the lower bootstrap bound of the fine arm against the coarse arm.

    contrasts: contrast, fine, coarse.  Test trials only.  Without attack trials of the fine arm
    the bound is null and nothing is shown; a coarse arm without any has recall 0.
    """
    test = scored.where("split = 'test'")
    lower = bootstrap_interval(recall_strata(test), ["scope"]).select(F.col("scope").alias("fine"), F.col("lower").alias("recall_lower"))
    outcomes = scope_outcomes(scored)
    recall = F.when(F.col("scenario_runs") > 0, F.col("true_positives") / F.col("scenario_runs")).otherwise(0.0)
    coarse = outcomes.select(F.col("scope").alias("coarse"), recall.alias("_recall"))
    rows = contrasts.join(lower, "fine", "left").join(coarse, "coarse", "left")
    shown = F.col("recall_lower") >= F.coalesce("_recall", F.lit(0.0)) - margin
    return rows.select("contrast", "recall_lower", F.coalesce(shown, F.lit(False)).alias("non_inferior"))


# --- context delta -----------------------------------------------------------------------


def context_delta(reference: str, observed: str) -> tuple[Column, Column]:
    """(score, differing fields) of two context structs with the weighted fields."""

    def differs(field: str) -> Column:
        return ~F.col(f"{reference}.{field}").eqNullSafe(F.col(f"{observed}.{field}"))

    score = sum(
        (F.when(differs(f), w).otherwise(0.0) for f, w in config.CONTEXT_WEIGHTS.items()), F.lit(0.0)
    )
    fields = F.array_compact(
        F.array(*[F.when(differs(f), F.lit(f)) for f in config.CONTEXT_WEIGHTS])
    )
    return F.round(F.least(score, F.lit(1.0)), 6), fields


def context_delta_trials(trials: DataFrame) -> DataFrame:
    """Context delta of every benign trial against the first fit trial of its digest.

    trials: trial_id, image_digest, context_variant, split, attack_like, context.
    """
    benign = trials.where("NOT attack_like")
    fit = benign.where("split = 'fit'")
    reference = fit.groupBy("image_digest").agg(
        F.min_by(F.struct(F.col("context").alias("c"), "context_variant"), "trial_id").alias("_r")
    )
    reference = reference.select(
        "image_digest",
        F.col("_r.c").alias("reference"),
        F.col("_r.context_variant").alias("reference_variant"),
    )
    score, fields = context_delta("reference", "context")
    joined = benign.join(reference, "image_digest", "left")
    known = F.col("reference").isNotNull()
    return joined.select(
        "trial_id",
        "image_digest",
        "context_variant",
        "split",
        "reference_variant",
        known.alias("has_reference"),
        F.when(known, score).alias("delta_score"),
        F.when(known, fields).alias("differing_fields"),
        F.when(known, score > 0).alias("positive"),
    )


def context_delta_by_variant(rows: DataFrame) -> DataFrame:
    return rows.where("split = 'test' AND has_reference").groupBy("context_variant").agg(
        F.count(F.lit(1)).alias("trials"), F.count_if("positive").alias("positives")
    )


def context_delta_coverage(rows: DataFrame, alpha: float = config.COVERAGE_ALPHA) -> DataFrame:
    """Calibration trials ranked among the fit deltas of their digest."""
    values = rows.where("split = 'fit' AND has_reference").select(
        "image_digest", F.col("delta_score").alias("value")
    )
    held_out = rows.where("split = 'calibration'").withColumn("value", F.col("delta_score"))
    ranked = empirical_pvalues(values, held_out, ["image_digest"])
    known = F.col("has_reference")
    drift = F.coalesce(F.col("context_variant") != F.col("reference_variant"), F.lit(False))
    status = F.when(~known, "insufficient_profile").when(drift, "drift_detected").otherwise("scored")
    p = F.when(known & ~drift, F.col("p_value"))
    return ranked.select(
        "trial_id",
        "delta_score",
        status.alias("status"),
        p.alias("p_value"),
        F.coalesce(p > alpha, F.lit(False)).alias("covered"),
    )


# --- boundaries, markers, load -----------------------------------------------------------


def missing_sequences(generated: DataFrame, observed: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(trial_id, boundary, sequence) that were generated but not seen there."""
    wanted = generated.select("trial_id", "sequence").distinct().join(
        boundaries.where("measured").select("trial_id", "boundary"), "trial_id"
    )
    return wanted.join(observed, ["trial_id", "boundary", "sequence"], "left_anti")


def reconcile_boundaries(
    generated: DataFrame, observed: DataFrame, boundaries: DataFrame
) -> DataFrame:
    """Loss per trial and boundary; boundaries that were not measured carry no numbers.

    generated    trial_id, sequence
    observed     trial_id, boundary, sequence (repeats count as duplicates)
    boundaries   trial_id, boundary, measured
    """
    made = generated.select("trial_id", "sequence").distinct()
    totals = made.groupBy("trial_id").agg(F.count(F.lit(1)).alias("generated"))
    seen = observed.groupBy("trial_id", "boundary", "sequence").agg(F.count(F.lit(1)).alias("copies"))
    marked = seen.join(made.withColumn("_made", F.lit(True)), ["trial_id", "sequence"], "left")
    counts = marked.groupBy("trial_id", "boundary").agg(
        F.count(F.lit(1)).alias("observed"),
        F.count("_made").alias("matched"),
        F.count_if(F.col("_made").isNull()).alias("unexpected"),
        F.sum(F.col("copies") - 1).alias("duplicates"),
    )
    joined = boundaries.join(totals, "trial_id", "left").join(counts, ["trial_id", "boundary"], "left")
    joined = joined.fillna(0, ["generated", "observed", "matched", "unexpected", "duplicates"])
    measured, missing = F.col("measured"), F.col("generated") - F.col("matched")
    return joined.select(
        "trial_id",
        "boundary",
        F.when(measured, "measured").otherwise("unmeasured").alias("status"),
        "generated",
        *[F.when(measured, F.col(c)).alias(c) for c in ("observed", "unexpected", "duplicates")],
        F.when(measured, missing).alias("missing"),
        F.when(measured & (F.col("generated") > 0), missing / F.col("generated")).alias("loss_fraction"),
    )


def extract_markers(execs: DataFrame, pattern: str) -> DataFrame:
    """(container_id, event_id, sequence) of command lines that carry a numbered marker."""
    number = F.regexp_extract(F.coalesce("command_line", F.lit("")), pattern, 1)
    rows = execs.select("container_id", "event_id", number.alias("_n")).where(F.length("_n") > 0)
    return rows.dropDuplicates(["container_id", "event_id"]).select(
        "container_id", "event_id", F.col("_n").cast("bigint").alias("sequence")
    )


def marker_summary(markers: DataFrame) -> DataFrame:
    """Distinct sequences and repeats per container."""
    once = markers.groupBy("container_id", "sequence").agg(F.count(F.lit(1)).alias("copies"))
    return once.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("sequences"), F.sum(F.col("copies") - 1).alias("duplicates")
    )


def load_percentiles(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99 of raw samples, per key."""
    found = exact_quantiles(samples, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.withColumns({name: F.round(name, 4) for name in ("p50", "p95", "p99")})


def run_totals(trials: DataFrame, boundary_rows: DataFrame) -> DataFrame:
    """One row: runs, trials, completed, sequences generated and seen per boundary."""
    heads = trials.agg(
        F.count_distinct("run_id").alias("runs"),
        F.count(F.lit(1)).alias("trials"),
        F.count_if(F.col("status") == "completed").alias("completed"),
    )
    seen = boundary_rows.agg(
        F.sum(F.when(F.col("boundary") == "source", F.col("generated"))).alias("generated"),
        F.sum(F.when(F.col("boundary") == "source", F.col("observed"))).alias("at_source"),
        F.sum(F.when(F.col("boundary") == "database", F.col("observed"))).alias("stored"),
    )
    return heads.withColumn("_k", F.lit(1)).join(seen.withColumn("_k", F.lit(1)), "_k").drop("_k")


# --- structure, plan, pilot --------------------------------------------------------------


def structural_violations(trials: DataFrame) -> DataFrame:
    """(trial_id, violation) rows; an empty result means the records are well formed.

    trials: trial_id, status, failure_reason, image_reference.
    """
    status = F.col("status")
    checks = F.array_compact(
        F.array(
            F.when(~F.coalesce(status.isin("completed", "failed"), F.lit(False)), F.lit("no_terminal_status")),
            F.when(
                (status == "failed") & (F.coalesce(F.length("failure_reason"), F.lit(0)) == 0),
                F.lit("failed_without_reason"),
            ),
            F.when(
                (status == "completed") & ~F.coalesce(F.contains("image_reference", F.lit("@sha256:")), F.lit(False)),
                F.lit("digest_not_pinned"),
            ),
        )
    )
    single = trials.select("trial_id", F.explode(checks).alias("violation"))
    repeated = trials.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return single.unionByName(repeated.select("trial_id", F.lit("duplicate_trial_id").alias("violation")))


def group_coverage(trials: DataFrame) -> DataFrame:
    """Distinct replicas and clean runs per (version, variant, split)."""
    clean = ~F.col("attack_like")
    return trials.groupBy("workload_id", "context_variant", "split").agg(
        F.count_distinct("replica_index").alias("replicas"), F.count_if(clean).alias("clean_runs")
    )


def plan_cells(plan: DataFrame, trials: DataFrame) -> DataFrame:
    """Required cells with their counts.

    plan: cell_kind (benign or scenario), workload_id, item (mode or scenario id), minimum.
    """
    benign = trials.where("NOT attack_like").select(
        F.lit("benign").alias("cell_kind"), "workload_id", F.col("mode").alias("item")
    )
    scenario = trials.where("scenario_id IS NOT NULL").select(
        F.lit("scenario").alias("cell_kind"), "workload_id", F.col("scenario_id").alias("item")
    )
    keys = ["cell_kind", "workload_id", "item"]
    counts = benign.unionByName(scenario).groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    joined = plan.join(counts, keys, "left").fillna(0, ["found"])
    return joined.withColumn("satisfied", F.col("found") >= F.col("minimum"))


def conformance(
    plan: DataFrame,
    trials: DataFrame,
    hard_negatives: DataFrame,
    known_scenarios: DataFrame,
    min_replicas: int = config.MIN_REPLICAS,
    min_stratum: int = config.MIN_STRATUM_RUNS,
) -> DataFrame:
    """Check rows (check_id, subject, found, required, satisfied) of all plan rules.

    plan             as in :func:`plan_cells`
    hard_negatives   workload_family, hard_negative_id that must appear
    known_scenarios  scenario_id of the protocol
    """
    done = trials.where("status = 'completed'")

    def rows(df: DataFrame, check: str, subject: Column, found: Column, required: Column, ok: Column) -> DataFrame:
        return df.select(
            F.lit(check).alias("check_id"),
            subject.alias("subject"),
            found.cast("bigint").alias("found"),
            required.cast("bigint").alias("required"),
            ok.alias("satisfied"),
        )

    def present(items: DataFrame, keys: list[str], check: str) -> DataFrame:
        counts = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
        joined = items.select(*keys).distinct().join(counts, keys, "left").fillna(0, ["found"])
        subject = F.concat_ws("|", *keys)
        return rows(joined, check, subject, F.col("found"), F.lit(1), F.col("found") >= 1)

    scenario_plan = plan.where("cell_kind = 'scenario'").withColumnRenamed("item", "scenario_id")
    mode_plan = plan.where("cell_kind = 'benign'").withColumnRenamed("item", "mode")
    unknown = (
        done.where("scenario_id IS NOT NULL")
        .join(known_scenarios, "scenario_id", "left_anti")
        .groupBy("scenario_id")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    untold = done.agg(F.count_if(F.col("expected_outcome").isNull()).alias("found"))
    # One row per required (version, split), however many trials there are.
    wanted = (
        plan.select("workload_id")
        .distinct()
        .select("workload_id", F.explode(F.array(*[F.lit(s) for s in config.SPLITS])).alias("split"))
    )
    replicas = done.groupBy("workload_id", "split").agg(F.count_distinct("replica_index").alias("found"))
    replica_rows = wanted.join(replicas, ["workload_id", "split"], "left").fillna(0, ["found"])
    clean = done.where("NOT attack_like AND split IN ('fit', 'calibration')")
    strata = clean.groupBy("workload_id", "context_variant").agg(
        F.least(
            F.count_if(F.col("split") == "fit"), F.count_if(F.col("split") == "calibration")
        ).alias("found")
    )
    cells = plan_cells(plan, done)
    found = F.col("found")
    parts = [
        present(scenario_plan, ["scenario_id"], "scenario_present"),
        rows(unknown, "scenario_exploratory", F.col("scenario_id"), found, F.lit(0), F.lit(True)),
        present(plan, ["workload_id"], "version_present"),
        present(mode_plan, ["workload_id", "mode"], "mode_present"),
        present(hard_negatives, ["workload_family", "hard_negative_id"], "hard_negative_present"),
        rows(untold, "ground_truth_present", F.lit("all"), found, F.lit(0), found == 0),
        rows(
            replica_rows,
            "replicas_per_split",
            F.concat_ws("|", "workload_id", "split"),
            found,
            F.lit(min_replicas),
            found >= min_replicas,
        ),
        rows(
            strata,
            "clean_runs_per_stratum",
            F.concat_ws("|", "workload_id", "context_variant"),
            found,
            F.lit(min_stratum),
            found >= min_stratum,
        ),
        rows(
            cells,
            "cell_count",
            F.concat_ws("|", "cell_kind", "workload_id", "item"),
            found,
            F.col("minimum"),
            F.col("satisfied"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pilot_inputs(tested: DataFrame, outcomes: DataFrame, contrasts: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Pooled discordance and comparator FPR per contrast; a constant comparator is refused."""
    arms = outcomes.sparkSession.createDataFrame(
        [(name, b) for name, _, b in contrasts], "contrast string, scope string"
    )
    pooled = tested.groupBy("contrast").agg(
        F.sum(F.col("only_a") + F.col("only_b")).alias("discordant"), F.sum("n_pairs").alias("pairs")
    )
    rates = outcomes.groupBy("scope").agg(
        F.sum("false_positives").alias("false_positives"), F.sum("benign_runs").alias("benign_runs")
    )
    joined = arms.join(pooled, "contrast", "left").join(rates, "scope", "left")
    fpr = F.when(F.col("benign_runs") > 0, F.col("false_positives") / F.col("benign_runs"))
    return joined.select(
        "contrast",
        "discordant",
        "pairs",
        fpr.alias("baseline_fpr"),
        F.coalesce((fpr > 0) & (fpr < 1), F.lit(False)).alias("usable"),
    )


def tag_drift(references: DataFrame, trials: DataFrame) -> DataFrame:
    """Distance between the references of digests that one tag has pointed at.

    references: rows of the digest scope.  The first digest of a tag is its reference.  A
    pair of which one side has no reference is kept without a distance.
    """
    digests = trials.select("human_tag", "image_digest").distinct()
    first = digests.groupBy("human_tag").agg(
        F.min("image_digest").alias("first_digest"), F.count(F.lit(1)).alias("digests")
    )
    moved = digests.join(first.where("digests > 1"), "human_tag")
    moved = moved.where(F.col("image_digest") != F.col("first_digest"))
    by_digest = references.where("scope = 'ARM-DIGEST'").select(
        F.col("reference_key").alias("digest"), "token", "n"
    )
    base = first.select("human_tag", F.col("first_digest").alias("digest")).join(by_digest, "digest")
    seen = moved.withColumnRenamed("image_digest", "digest").join(by_digest, "digest")
    compared = compare_tokens(base, seen, ["human_tag"], ["human_tag", "digest"])
    usable = compared.join(base.select("human_tag").distinct(), "human_tag", "left_semi")
    pairs = moved.select("human_tag", F.col("image_digest").alias("digest"))
    joined = pairs.join(usable.select("human_tag", "digest", "js_distance"), ["human_tag", "digest"], "left")
    return joined.withColumn("has_references", F.col("js_distance").isNotNull())


def multiset_diff(
    rows: DataFrame, group: str, baseline: str, variants: Sequence[str], items: Sequence[str]
) -> DataFrame:
    """Items each of the named variants has more or fewer of than the baseline group."""
    counts = rows.groupBy(group, *items).agg(F.count(F.lit(1)).alias("n"))
    base = counts.where(F.col(group) == baseline).select(*items, F.col("n").alias("base_n"))
    others = counts.where(F.col(group).isin(list(variants)))
    # Every variant is compared with every baseline item, so that removed ones are visible.
    labels = F.explode(F.array(*[F.lit(v) for v in variants])).alias(group)
    offered = base.select("*", labels)
    left, right = others.alias("o"), offered.alias("b")
    on = F.col(f"o.{group}") == F.col(f"b.{group}")
    for item in items:
        on = on & F.col(f"o.{item}").eqNullSafe(F.col(f"b.{item}"))
    joined = left.join(right, on, "full_outer").select(
        F.coalesce(F.col(f"o.{group}"), F.col(f"b.{group}")).alias(group),
        *[F.coalesce(F.col(f"o.{i}"), F.col(f"b.{i}")).alias(i) for i in items],
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("base_n", F.lit(0)).alias("base_n"),
    )
    return joined.where("n <> base_n").select(
        group,
        *items,
        F.greatest(F.col("n") - F.col("base_n"), F.lit(0)).alias("added"),
        F.greatest(F.col("base_n") - F.col("n"), F.lit(0)).alias("removed"),
    )


def outcome_metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision and the share of trials that could not be judged."""
    known, attack, positive = F.col("has_reference"), F.col("attack_like"), F.col("positive")
    hits, calls = F.count_if(known & attack & positive), F.count_if(known & positive)
    return scored.where("split = 'test'").groupBy(*keys).agg(
        F.when(calls > 0, hits / calls).alias("precision"),
        (F.count_if(~known) / F.count(F.lit(1))).alias("insufficient_fraction"),
    )


def first_evidence(actions: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds from an action to the first evidence at or after it.

    actions: keys, action_us; evidence: keys, evidence_us.
    """
    # Backwards in time the nearest evidence is carried to each action; nothing is paired.
    keys = list(keys)
    seen = evidence.select(*keys, F.col("evidence_us").alias("at"), F.lit(0).alias("kind")).distinct()
    asked = actions.select(*keys, F.col("action_us").alias("at"), F.lit(1).alias("kind")).distinct()
    rows = seen.unionByName(asked).withColumns(
        {"back": -F.col("at"), "evidence": F.when(F.col("kind") == 0, F.col("at"))}
    )
    found = Ordered(rows, keys, ["back", "kind"]).last("evidence", "nearest").rows.where("kind = 1")
    return found.select(
        *keys,
        F.col("at").alias("action_us"),
        ((F.col("nearest") - F.col("at")) / 1e6).alias("seconds_to_evidence"),
    )


def persistence_latency(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percentiles of seconds from occurrence to receipt."""
    delay = (F.unix_micros("received_at") - F.unix_micros("occurred_at")) / 1e6
    return load_percentiles(events.select(*keys, delay.alias("delay")), keys, "delay")
