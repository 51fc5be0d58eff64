"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import decontaminate, divergence, katz, langid, line_dedup, merkle, ngram_join, pieces, quality, recompression, secrets, token_counts, toxicity

QUERIES = {
    "op1_katz": katz.op1_katz,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_language_id": langid.op3_language_id,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_secrets": secrets.op8_secrets,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_substring_dedup": recompression.op12_substring_dedup,
    "op13_divergence": divergence.op13_divergence,
}
ORACLE_SQL = {"op6_quality_rules": quality.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_substring_dedup": recompression.ORACLE, "op13_divergence": divergence.ORACLE}
