"""Distance of an observed window from its baseline, with the full explanation."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runwarden import config
from runwarden.functions.hashing import sha256_fields


def literal_map(values: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def _log2_share(part: Column, other: Column) -> Column:
    """part * log2(part / midpoint), zero for an absent part."""
    return F.when(part > 0, part * F.log2(2 * part / (part + other))).otherwise(0.0)


def compare_tokens(
    baseline: DataFrame,
    observed: DataFrame,
    base_keys: Sequence[str] = ("image_digest", "family"),
    observed_keys: Sequence[str] = ("image_digest", "w", "family"),
) -> DataFrame:
    """Jensen-Shannon and Hellinger distance and unseen mass per observed group.

    Both inputs carry ``token`` and a count ``n``.  Only observed tokens are joined:
    the baseline tokens that a window does not show contribute their plain mass,
    which is the baseline total less the matched counts.  The baseline is therefore
    never copied once per window.  Groups without observations have no row.
    """
    base_keys, observed_keys = list(base_keys), list(observed_keys)
    base_totals = baseline.groupBy(*base_keys).agg(F.sum("n").alias("base_total"))
    seen_totals = observed.groupBy(*observed_keys).agg(F.sum("n").alias("seen_total"))
    known = baseline.select(*base_keys, "token", F.col("n").alias("base_n"))
    joined = (
        observed.select(*observed_keys, "token", F.col("n").alias("seen_n"))
        .join(known, [*base_keys, "token"], "left")
        .join(seen_totals, observed_keys)
        .join(base_totals, base_keys, "left")
    )
    p = F.coalesce(F.col("base_n") / F.col("base_total"), F.lit(0.0))
    q = F.col("seen_n") / F.col("seen_total")
    grouped = joined.groupBy(*observed_keys).agg(
        F.first("base_total").alias("base_total"),
        F.first("seen_total").alias("seen_total"),
        F.sum(F.coalesce("base_n", F.lit(0))).alias("matched_n"),
        F.sum(_log2_share(p, q)).alias("kl_base"),
        F.sum(_log2_share(q, p)).alias("kl_seen"),
        F.sum(F.pow(F.sqrt(p) - F.sqrt(q), 2)).alias("root_gap"),
        F.sum(F.when(F.col("base_n").isNull(), F.col("seen_n")).otherwise(0)).alias("unseen_n"),
        F.count_if(F.col("base_n").isNull()).alias("unseen_tokens"),
    )
    missing_mass = (F.col("base_total") - F.col("matched_n")) / F.col("base_total")
    divergence = 0.5 * (F.col("kl_base") + missing_mass + F.col("kl_seen"))
    bounded = F.sqrt(F.greatest(F.least(divergence, F.lit(1.0)), F.lit(0.0)))
    hellinger = F.sqrt(0.5 * (F.col("root_gap") + missing_mass))
    no_baseline = F.col("base_total").isNull()
    return grouped.select(
        *observed_keys,
        "seen_total",
        "unseen_tokens",
        F.round(F.when(no_baseline, 1.0).otherwise(bounded), 12).alias("js_distance"),
        F.round(
            F.when(no_baseline, 1.0).otherwise(F.least(hellinger, F.lit(1.0))), 12
        ).alias("hellinger"),
        F.round(F.col("unseen_n") / F.col("seen_total"), 12).alias("novelty"),
    )


def novel_tokens(baseline: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed tokens that the baseline of the same digest and family lacks."""
    return observed.join(baseline, ["image_digest", "family", "token"], "left_anti")


def numeric_deviation(observed: DataFrame, summary: DataFrame) -> DataFrame:
    """Clipped z-score of each window feature against the baseline summary.

    ``observed`` is wide (digest, w, one column per feature), ``summary`` has one row
    per (digest, feature).
    """
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f).alias("observed"))
            for f in config.NUMERIC_WEIGHTS
        ]
    )
    rows = observed.select("image_digest", "w", F.inline(pairs))
    joined = rows.join(
        summary.select("image_digest", "feature", "median", "p95", "stddev"),
        ["image_digest", "feature"],
    )
    floor = literal_map(config.NUMERIC_FLOORS)[F.col("feature")]
    scale = F.greatest(
        F.col("stddev"),
        F.abs(F.col("p95") - F.col("median")) / config.NORMAL_P95,
        F.abs("median") * 0.10,
        floor,
    )
    z = F.abs(F.col("observed") - F.col("median")) / scale
    width = config.Z_SATURATION - config.Z_TOLERANCE
    return joined.select(
        "image_digest",
        "w",
        "feature",
        F.round(F.greatest(F.least((z - config.Z_TOLERANCE) / width, F.lit(1.0)), F.lit(0.0)), 12).alias(
            "deviation"
        ),
        "observed",
        "median",
        "p95",
        "stddev",
        F.round(scale, 12).alias("scale"),
        F.round(z, 12).alias("abs_z"),
    )


def weighted_average(
    rows: DataFrame, keys: Sequence[str], name: str, value: str, weights: Mapping[str, float], alias: str
) -> DataFrame:
    """Average over the members that are present, their weights rescaled to one.

    The sum of the weights present is kept as ``<alias>_weight`` for explanations.
    """
    weight = F.when(F.col(value).isNotNull(), literal_map(weights)[F.col(name)])
    return rows.groupBy(*keys).agg(
        F.round(F.sum(weight * F.col(value)) / F.sum(weight), 12).alias(alias),
        F.sum(weight).alias(f"{alias}_weight"),
    )


def band(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for limit, label in config.SCORE_BANDS:
        out = out.when(score < limit, F.lit(label))
    return out.otherwise(F.lit(config.TOP_BAND))


def anomaly_scores(
    spine: DataFrame,
    window_sizes: DataFrame,
    families: DataFrame,
    deviations: DataFrame,
    min_process_events: int = config.MIN_PROCESS_EVENTS,
) -> DataFrame:
    """Total score, components, band and status of every window of the spine.

    spine         image_digest, w
    window_sizes  image_digest, w, exec_count, lifecycle_count (missing rows mean 0)
    families      output of :func:`compare_tokens`
    deviations    output of :func:`numeric_deviation`
    """
    keys = ["image_digest", "w"]
    categorical = weighted_average(
        families, keys, "family", "js_distance", config.FAMILY_WEIGHTS, "categorical_distance"
    )
    novelty = weighted_average(families, keys, "family", "novelty", config.FAMILY_WEIGHTS, "novelty_score")
    both = categorical.join(novelty, keys)
    numeric = weighted_average(
        deviations, keys, "feature", "deviation", config.NUMERIC_WEIGHTS, "numeric_deviation"
    )
    joined = (
        spine.join(window_sizes.select(*keys, "exec_count", "lifecycle_count"), keys, "left")
        .join(both, keys, "left")
        .join(numeric, keys, "left")
        .fillna(0, ["exec_count", "lifecycle_count"])
    )
    parts = {
        "categorical_distance": F.col("categorical_distance"),
        "novelty": F.col("novelty_score"),
        "numeric_deviation": F.col("numeric_deviation"),
    }
    weight = sum(
        (F.when(c.isNotNull(), config.GROUP_WEIGHTS[g]).otherwise(0.0) for g, c in parts.items()),
        F.lit(0.0),
    )
    weighted = sum(
        (config.GROUP_WEIGHTS[g] * F.coalesce(c, F.lit(0.0)) for g, c in parts.items()), F.lit(0.0)
    )
    enough = F.col("exec_count") >= min_process_events
    total = F.when(enough & (weight > 0), F.round(weighted / weight, 12))
    return joined.select(
        *keys,
        "exec_count",
        "lifecycle_count",
        F.when(enough, F.lit("scored")).otherwise(F.lit("insufficient_data")).alias("status"),
        total.alias("total_score"),
        F.when(enough, band(total)).otherwise(F.lit("insufficient_data")).alias("score_band"),
        F.when(enough, F.col("categorical_distance")).alias("categorical_distance"),
        F.when(enough, F.col("novelty_score")).alias("novelty_score"),
        F.when(enough, F.col("numeric_deviation")).alias("numeric_deviation"),
        "categorical_distance_weight",
        "novelty_score_weight",
        "numeric_deviation_weight",
        F.when(enough, weight).alias("group_weight"),
    )


def scoring_config_hash() -> str:
    """Identity of the weights and floors in use."""
    tables = (config.GROUP_WEIGHTS, config.FAMILY_WEIGHTS, config.NUMERIC_WEIGHTS, config.NUMERIC_FLOORS)
    text = ",".join(f"{name}={value!r}" for table in tables for name, value in table.items())
    return hashlib.sha256(text.encode()).hexdigest()


def observation_key(
    profile_id: Column, model_hash: Column, start_us: Column, end_us: Column, event_set: Column
) -> Column:
    """Identity of an observation: equal inputs and configuration give the same key."""
    return sha256_fields(
        {
            "profile_id": profile_id,
            "profile_model_hash": model_hash,
            "window_start": start_us,
            "window_end": end_us,
            "event_set": event_set,
            "scoring_config": F.lit(scoring_config_hash()),
        }
    )


# --- explanation -------------------------------------------------------------------------


def _top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def contributions(scores: DataFrame, families: DataFrame, deviations: DataFrame) -> DataFrame:
    """Weighted contribution of every family and feature to a window's score."""
    keys = ["image_digest", "w"]
    scored = scores.where("status = 'scored'")
    family_weight = literal_map(config.FAMILY_WEIGHTS)[F.col("family")]
    feature_weight = literal_map(config.NUMERIC_WEIGHTS)[F.col("feature")]
    family_rows = families.join(scored, keys).select(
        *keys,
        F.inline(
            F.array(
                _contribution(
                    "categorical_distance",
                    F.col("family"),
                    F.col("js_distance"),
                    family_weight / F.col("categorical_distance_weight"),
                ),
                _contribution(
                    "novelty", F.col("family"), F.col("novelty"), family_weight / F.col("novelty_score_weight")
                ),
            )
        ),
    )
    numeric_rows = deviations.join(scored, keys).select(
        *keys,
        F.inline(
            F.array(
                _contribution(
                    "numeric_deviation",
                    F.col("feature"),
                    F.col("deviation"),
                    feature_weight / F.col("numeric_deviation_weight"),
                )
            )
        ),
    )
    return family_rows.unionByName(numeric_rows)


def _contribution(kind: str, feature: Column, raw: Column, share: Column) -> Column:
    group = config.GROUP_WEIGHTS[kind] / F.col("group_weight")
    return F.struct(
        F.lit(kind).alias("kind"),
        feature.alias("feature"),
        raw.alias("raw_score"),
        F.round(group * share * raw, 12).alias("contribution"),
    )


def top_contributors(rows: DataFrame, limit: int = config.TOP_CONTRIBUTORS) -> DataFrame:
    order = [F.desc("contribution"), F.asc("kind"), F.asc("feature")]
    return _top(rows, ["image_digest", "w"], order, limit)


def token_shares(observed: DataFrame) -> DataFrame:
    """Share of every observed token within (digest, window, family)."""
    keys = ["image_digest", "w", "family"]
    totals = observed.groupBy(*keys).agg(F.sum("n").alias("total"))
    return observed.join(totals, keys).select(
        *keys, "token", "n", F.round(F.col("n") / F.col("total"), 12).alias("proportion")
    )


def top_unseen(baseline: DataFrame, shares: DataFrame, limit: int = config.TOP_UNSEEN) -> DataFrame:
    """Unseen tokens with the largest shares, over all families of a window."""
    unseen = novel_tokens(baseline, shares)
    order = [F.desc("proportion"), F.asc("family"), F.asc("token")]
    return _top(unseen, ["image_digest", "w"], order, limit)


def top_observed(shares: DataFrame, limit: int = config.TOP_OBSERVED) -> DataFrame:
    order = [F.desc("proportion"), F.asc("token")]
    return _top(shares, ["image_digest", "w", "family"], order, limit)


def top_numeric(deviations: DataFrame, limit: int = config.TOP_NUMERIC) -> DataFrame:
    order = [F.desc("deviation"), F.asc("feature")]
    return _top(deviations, ["image_digest", "w"], order, limit)
