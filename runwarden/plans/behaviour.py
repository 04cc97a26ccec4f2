"""Baseline and score of every image and window in one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden import config
from runwarden.operators import profile, score
from runwarden.session import materialize


@dataclass(frozen=True)
class Interval:
    """Training [start, cut) and scoring [cut, end) interval with one window width."""

    start_us: int
    cut_us: int
    end_us: int
    window_us: int

    @property
    def training_windows(self) -> int:
        return max(1, -(-(self.cut_us - self.start_us) // self.window_us))

    @property
    def scoring_windows(self) -> int:
        return max(1, -(-(self.end_us - self.cut_us) // self.window_us))


def window_of(interval: Interval) -> F.Column:
    """Window index relative to the cut: negative for training, 0, 1, … for scoring."""
    at = profile.micros(F.col("occurred_at"))
    i = interval
    before = profile.window_index(at, i.start_us, i.window_us, i.cut_us) - i.training_windows
    after = profile.window_index(at, i.cut_us, i.window_us, i.end_us)
    return F.when(at < i.cut_us, before).otherwise(after)


def within(interval: Interval) -> F.Column:
    at = profile.micros(F.col("occurred_at"))
    return (at >= interval.start_us) & (at < interval.end_us)


class Behaviour:
    """Plans of a behaviour analysis over one training and one scoring interval.

    ``counts`` is the only place that reads the events.  It is a small table, used
    by every later step, so it is written once to the checkpoint folder instead of
    being recomputed from the events by each of them.
    """

    def __init__(self, execs: DataFrame, lifecycle: DataFrame, interval: Interval):
        self.interval = interval
        self.execs = execs.where(within(interval)).withColumn("w", window_of(interval))
        self.lifecycle = lifecycle.where(within(interval)).withColumn("w", window_of(interval))

    @cached_property
    def counts(self) -> DataFrame:
        """(image_digest, w, family, token, n); training bigrams are all at w = -1."""
        whole_training = F.greatest(F.col("w"), F.lit(-1).cast("bigint"))
        bigrams = profile.sequence_bigrams(
            self.execs.withColumn("w", whole_training), ["image_digest", "w"]
        )
        return materialize(profile.windowed_counts(self.execs, self.lifecycle).unionByName(bigrams))

    @cached_property
    def baseline(self) -> DataFrame:
        """(image_digest, family, token, n) over the training interval."""
        rows = self.counts.where((F.col("w") < 0) & (F.col("family") != profile.SHELL_FAMILY))
        return materialize(
            rows.groupBy("image_digest", "family", "token").agg(F.sum("n").alias("n"))
        )

    @cached_property
    def observed(self) -> DataFrame:
        """(image_digest, w, family, token, n) of the scoring windows."""
        return self.counts.where((F.col("w") >= 0) & (F.col("family") != profile.SHELL_FAMILY))

    @cached_property
    def numbers(self) -> DataFrame:
        """Per-window numbers of the non-empty windows, training and scoring."""
        rows = self.counts.where(F.col("family") != "process_sequence_bigram")
        return profile.window_numbers(rows, self.interval.window_us)

    @cached_property
    def numeric_summary(self) -> DataFrame:
        training = self.numbers.where("w < 0")
        count = self.interval.training_windows
        spine = profile.window_spine(training, -count, count)
        return materialize(profile.numeric_summary(profile.fill_windows(training, spine)))

    @cached_property
    def spine(self) -> DataFrame:
        """Every scoring window of every digest that has a baseline."""
        return profile.window_spine(self.numeric_summary, 0, self.interval.scoring_windows)

    @cached_property
    def families(self) -> DataFrame:
        return score.compare_tokens(self.baseline, self.observed)

    @cached_property
    def deviations(self) -> DataFrame:
        filled = profile.fill_windows(self.numbers.where("w >= 0"), self.spine)
        return score.numeric_deviation(filled, self.numeric_summary)

    def scores(self, min_process_events: int = config.MIN_PROCESS_EVENTS) -> DataFrame:
        sizes = self.numbers.where("w >= 0")
        return score.anomaly_scores(
            self.spine, sizes, self.families, self.deviations, min_process_events
        )


def drift_ranking(execs: DataFrame, interval: Interval) -> DataFrame:
    """Which image-windows drift most from their baseline in executables?

    The flagship question.  The executions are scanned once; their counts per (image,
    window, executable) go to the checkpoint folder and everything else reads those.
    """
    rows = execs.where(within(interval)).withColumn("w", window_of(interval))
    rows = rows.withColumn("w", F.greatest("w", F.lit(-1).cast("bigint")))
    counts = rows.groupBy("image_digest", "w", profile.process_token().alias("token")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = materialize(counts)
    compared = score.compare_tokens(
        counts.where("w = -1").drop("w"), counts.where("w >= 0"), ["image_digest"], ["image_digest", "w"]
    )
    return compared.select(
        "image_digest",
        "w",
        F.col("seen_total").alias("exec_count"),
        F.round("js_distance", 9).alias("js_distance"),
        F.round("novelty", 9).alias("novelty"),
        score.band(F.col("js_distance")).alias("score_band"),
    )
