"""Queries of the learned models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runwarden.llm.benign_commands import SAMPLE_ROWS, score_benign
from runwarden.llm.command_model import score_command_lines
from runwarden.llm.description_language import identify_language
from runwarden.session import materialize


#: Labelled documents that are joined to their texts before the classifier samples them.
LABELLED_ROWS = 4 * SAMPLE_ROWS


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % folds


def held_out(doc_id: str, folds: int, which: int) -> Column:
    """Whether a document is in the fold that nothing is learned from; a null id is in none and trains nothing."""
    return F.coalesce(fold(doc_id, folds) == which, F.lit(False))


def language_of_documents(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(finding_id, language, score); learns from documents outside fold 1 of 3."""
    training = docs.where(fold("doc_id", 3) != 1).select(
        F.col("text").alias("description"), F.col("lang").alias("language")
    )
    rows = docs.withColumnsRenamed({"doc_id": "finding_id", "text": "description"})
    return identify_language(rows, training, carry=carry)


def quality_of_documents(docs: DataFrame, labels: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(event_id, score, predicted); learns from labels outside fold 1 of 3.

    A document with contradicting labels teaches nothing.  Of the labelled documents about
    ``LABELLED_ROWS``, chosen by the hash of their id, are joined to their texts.
    """
    rows = docs.withColumnsRenamed({"doc_id": "event_id", "text": "command_line"})
    known = labels.where(fold("doc_id", 3) != 1).where("quality IN (0, 1)")
    known = known.groupBy(F.col("doc_id").alias("event_id")).agg(
        F.min("quality").alias("benign"), F.max("quality").alias("other")
    )
    known = known.where("benign = other").drop("other")
    matched = materialize(rows.select("event_id").distinct().join(known, "event_id"))
    share = int(2**32 * min(1.0, LABELLED_ROWS / max(matched.count(), 1)))
    # Written, so that the join below knows how small it is.
    chosen = materialize(matched.where(F.shiftrightunsigned(F.xxhash64("event_id", F.lit(5)), 32) < F.lit(share)))
    return score_benign(rows, rows.select("event_id", "command_line").join(chosen, "event_id"), carry=carry)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return language_of_documents(docs).select(
        F.col("finding_id").alias("doc_id"),
        held_out("finding_id", 3, 1).alias("held_out"),
        F.col("language").alias("lang_pred"),
        "score",
    )


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality_of_documents(docs, labels).select(
        F.col("event_id").alias("doc_id"), held_out("event_id", 3, 1).alias("held_out"), "score", "predicted"
    )


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("command_line"))
    scored = score_command_lines(rows, rows.where(fold("event_id", 10) != 0))
    return scored.select(
        F.col("event_id").alias("doc_id"), held_out("event_id", 10, 0).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
