"""Queries of token counts and of the training mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwarden.llm.mixture import mix_executions
from runwarden.llm.token_counts import count_tokens


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    events = docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("command_line"))
    counted = count_tokens(events, public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumnRenamed("event_id", "doc_id")


def mixture_of_documents(docs: DataFrame) -> DataFrame:
    events = docs.select(
        F.col("doc_id").alias("event_id"), F.col("source").alias("docker_host_id"), F.col("text").alias("command_line")
    )
    mixed = mix_executions(events)
    return mixed.select(
        F.col("event_id").alias("doc_id"), "size", "source_size", "target", "taken", "position"
    )


def op9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture_of_documents(spark.read.parquet(f"{folder}/documents.parquet"))


OP9_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes),
leveled AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER lower, 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0) AS DOUBLE) AS level
  FROM ranked WINDOW lower AS (ORDER BY CAST(source_size AS DOUBLE) / weight, rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, 3 * source_size <= level * weight AS limited FROM leveled),
targets AS (
  SELECT source, source_size, rank, CASE WHEN limited THEN CAST(3 * source_size AS DOUBLE)
    ELSE max(CASE WHEN NOT limited THEN level END) OVER () * weight END AS target FROM marked),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, [-0.5, 0.0, 0.5][t.rank % 3 + 1] AS tilt,
    floor(t.target / t.source_size) AS whole,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.place, r.size, r.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(least(whole + CASE WHEN 2 * start + size
      < 2 * (target - whole * source_size) THEN 1 ELSE 0 END, 3) AS BIGINT) ELSE 0 END AS copies,
    least((start + size / 2.0) / target, 1.0) AS share
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN CASE WHEN tilt = 0 THEN CAST(share AS DOUBLE)
    ELSE 2 * share / (1 - tilt + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)) END END AS position
FROM taken"""
