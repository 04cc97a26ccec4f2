"""Queries of the numbered operators and their checking SQL."""

from __future__ import annotations

from runwarden.llm import queries_codes, queries_counts, queries_models, queries_near, queries_texts

QUERIES = {
    "op1_ngram_jaccard_join": queries_near.op1_ngram_jaccard_join,
    "op2_language_id": queries_models.op2_language_id,
    "op3_lm_scoring": queries_models.op3_lm_scoring,
    "op4_license_scan": queries_texts.op4_license_scan,
    "op5_decontamination": queries_texts.op5_decontamination,
    "op6_warc": queries_texts.op6_warc,
    "op7_embedding_near_dedup": queries_near.op7_embedding_near_dedup,
    "op8_token_counts": queries_counts.op8_token_counts,
    "op9_mixture": queries_counts.op9_mixture,
    "op10_quality_classifier": queries_models.op10_quality_classifier,
    "op11_vector_codes": queries_codes.op11_vector_codes,
    "op12_bpe_codec": queries_codes.op12_bpe_codec,
    "op13_periodic_runs": queries_codes.op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op6_warc": queries_texts.OP6_SQL,
    "op9_mixture": queries_counts.OP9_SQL,
    "op11_vector_codes": queries_codes.OP11_SQL,
}
