"""Queries of vector codes, token ids and periodic runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwarden.llm.command_runs import command_runs
from runwarden.llm.command_tokens import decode_command_lines, encode_command_lines
from runwarden.llm.profile_codes import ENTRIES, PARTS, ROUNDS, SCALE, compress_profiles


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors; columns ``vec_id, code, error, label_error, codebooks_sha256``."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    coded = compress_profiles(
        vectors.select(
            F.col("vec_id").alias("profile_id"), F.col("label").alias("image_digest"), F.col("embedding").alias("vector")
        )
    )
    return coded.select(
        F.col("profile_id").alias("vec_id"), "code", "error", F.col("image_error").alias("label_error"), "codebooks_sha256"
    )


def op12_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all texts and what they decode to; null is an empty text."""
    import public_tokenizers

    file = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    encoded = encode_command_lines(docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("command_line")), file)
    decoded = decode_command_lines(encoded, file)
    return decoded.select(
        F.col("event_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("command_line", 256).alias("decoded_sha256"),
    )


def planted_runs(docs: DataFrame) -> DataFrame:
    """Documents as command lines; those whose hashed id ends in 0 get a periodic tail."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    marked = docs.select("doc_id", "text", hashed.alias("h"), F.expr("h div 10").alias("g"))
    words = F.when(F.expr("h % 10 = 0"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    sized = marked.withColumn("words", words).withColumn("n", F.size("words"))
    first = F.when(F.col("n") > 0, F.expr("g % n"))
    placed = sized.withColumn("a", first).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(words, (w, i) -> CASE WHEN i < a THEN w ELSE words[int(a + (i - a) % p)] END), ' ')")
    return placed.select(
        F.col("doc_id").alias("event_id"), F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("command_line")
    )


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of all documents: their number, the strongest one, digests of all and of the collapsed text."""
    found = command_runs(planted_runs(spark.read.parquet(f"{folder}/documents.parquet")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.select(
        F.col("event_id").alias("doc_id"), "n_runs",
        F.col("strongest.start").alias("start"), F.col("strongest.length").alias("length"), F.col("strongest.period").alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _op11_sql() -> str:
    """The rounds written out one after the other."""
    stages = [
        """kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""cut AS MATERIALIZED (SELECT vec_id, p, c, CAST(floor({SCALE} * v[p * (len(v) // {PARTS}) + c + 1]) AS BIGINT) AS x
  FROM kept, range({PARTS}) parts(p), range(4096) places(c) WHERE c < len(v) // {PARTS})""",
        f"""book0 AS MATERIALIZED (SELECT p, e, c, x FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e
  FROM kept QUALIFY e < {ENTRIES}) USING (vec_id))""",
    ]
    for turn in range(ROUNDS + 1):
        stages.append(
            f"""near{turn} AS MATERIALIZED (SELECT vec_id, p, e, d FROM (
  SELECT vec_id, cut.p, e, CAST(sum((cut.x - b.x) * (cut.x - b.x)) AS BIGINT) AS d
  FROM cut JOIN book{turn} b ON cut.p = b.p AND cut.c = b.c GROUP BY vec_id, cut.p, e)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""
        )
        if turn < ROUNDS:
            stages.append(
                f"""book{turn + 1} AS MATERIALIZED (SELECT b.p, b.e, b.c, coalesce(m.x, b.x) AS x FROM book{turn} b LEFT JOIN (
  SELECT p, e, c, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM cut JOIN near{turn} USING (vec_id, p)
  GROUP BY p, e, c) m ON b.p = m.p AND b.e = m.e AND b.c = m.c)"""
            )
    return (
        "WITH "
        + ",\n".join(stages)
        + f""",
coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, c)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
    )


OP11_SQL = _op11_sql()
