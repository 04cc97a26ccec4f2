"""Query of the near-duplicate join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwarden.llm.near_commands import near_duplicate_commands
from runwarden.llm.near_profiles import near_profiles


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    events = docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("command_line"))
    found = near_duplicate_commands(events)
    return found.select(F.col("event_id").alias("doc_id"), "n_shingles", "component_id")


def op7_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = near_profiles(
        vectors.select(
            F.col("vec_id").alias("profile_id"), F.col("label").alias("image_digest"), F.col("embedding").alias("vector")
        )
    )
    return found.withColumnRenamed("profile_id", "vec_id")
