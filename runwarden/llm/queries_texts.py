"""Queries of licences, leaks and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwarden.llm.feed_archive import archive_pages
from runwarden.llm.license_sentences import component_licenses
from runwarden.llm.trial_leaks import leaked_trials


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = docs.select(F.col("doc_id").alias("purl"), F.col("text").alias("license_text"))
    return component_licenses(texts).withColumnRenamed("purl", "doc_id")


def leaks_of_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    events = docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("command_line"))
    trials = benchmark.select(F.col("item_id").alias("trial_id"), F.col("text").alias("command_line"))
    return leaked_trials(events, trials)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = leaks_of_documents(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.withColumnsRenamed({"event_id": "doc_id", "trial_id": "item_id"})


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    records = archive_pages(pages.select("page_id", "url", F.col("html").alias("document")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, max(page_id) AS first FROM rows WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT r.page_id, CAST(r.payload_bytes AS BIGINT) AS payload_bytes, r.payload_digest,
  CASE WHEN f.first <> r.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> r.page_id THEN f.first END AS refers_to
FROM rows r LEFT JOIN firsts f ON f.payload_digest = r.payload_digest AND r.payload_bytes >= 1000"""
