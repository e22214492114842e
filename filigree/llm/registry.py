"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from filigree.llm import byte_bpe, decontamination, filter_audit, hard_negatives, html_extraction, mixing, ngram_join, pii, quality, sharding, suffix_dedup, tokens, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pii": pii.op6_pii,
    "op7_tokens": tokens.op7_tokens,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_quality": quality.op9_quality,
    "op10_html": html_extraction.op10_html,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {"op1_sharding": sharding.OP1_SQL, "op8_ngram_join": ngram_join.OP8_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
