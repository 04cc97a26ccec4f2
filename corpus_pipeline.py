"""Training corpus from the documents table: language, quality, duplicates, leaks, mixture.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the stage before kept.
All but the last return the columns of ``documents``; the last returns the mixture:
``doc_id, size, source_size, target, taken, position``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwarden.llm.near_commands import near_duplicate_commands
from runwarden.llm.queries_counts import mixture_of_documents
from runwarden.llm.queries_models import language_of_documents, quality_of_documents
from runwarden.llm.queries_texts import leaks_of_documents
from runwarden.session import materialize

#: A prediction below this probability is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language: not ``und`` and a score of at least 0.5.

    A null, empty or letterless text is ``und`` and goes.  Rows are judged one by one: repeated rows
    and rows without an id stay if their text is recognised.  Other columns, whatever their
    names, stay as they are; an empty table gives no rows.
    """
    packed = _packed(docs)
    known = language_of_documents(packed, carry=("description", "others"))
    kept = known.where((F.col("language") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return _unpacked(kept, "finding_id", "description", docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose predicted quality is 1.

    A null text is judged like an empty one.  Repeated rows, rows without an id, other columns and
    empty tables as in the language stage; without labels all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_of_documents(_packed(docs), labels, carry=("command_line", "others"))
    return _unpacked(scored.where("predicted = 1"), "event_id", "command_line", docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of every group of near-duplicates the document with the smallest id.

    Rows that repeat an id are one document, of which the row with the smallest text stays;
    documents without an id belong to no group and stay.
    """
    events = docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("command_line"))
    first = near_duplicate_commands(events).where("event_id = component_id").select(F.col("event_id").alias("doc_id"))
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id")
    whole = kept.agg(F.min(F.struct("text", *_others(docs))).alias("row")).select("doc_id", "row.*")
    return whole.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a passage of the benchmark.

    Leaks are found by text, so every row with that text goes, with or without an id; a null
    text stays.  An empty benchmark drops nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = docs.where("text IS NOT NULL").select(F.md5("text").alias("doc_id"), "text")
    leaked = materialize(leaks_of_documents(texts, benchmark).select(F.col("event_id").alias("leaked")).distinct())
    return docs.join(leaked, F.md5("text") == F.col("leaked"), "left_anti").select(docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the training mixture takes of each document, in range-sorted order of position.

    A null or blank text has size 0 and nothing is taken; a null source is a source of its own, the
    last one; repeated rows are documents of their own.
    """
    return mixture_of_documents(docs)


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang`` and one struct with all other columns, so that no name can clash."""
    return docs.select("doc_id", "text", "lang", F.struct(*_others(docs)).alias("others"))


def _unpacked(rows: DataFrame, doc_id: str, text: str, docs: DataFrame) -> DataFrame:
    named = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "others.*")
    return named.select(docs.columns)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near duplicates", duplicate_stage),
    ("decontamination", leak_stage),
    ("mixture", mixture_stage),
]

#: Learned models cannot be expressed in SQL; a test compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
