"""The operators' queries, and SQL where SQL can express one."""

from __future__ import annotations

from . import exact_dedup, hard_negatives, language_id, packing, quality_rules, secret_scan, sentence_pieces, sharding, simhash_dedup, suffix_dedup, token_counts, token_files, whitening

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_token_files": token_files.op3_token_files,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_packing": packing.op6_packing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_simhash_near_dedup": simhash_dedup.op9_simhash_near_dedup,
    "op10_sentence_pieces": sentence_pieces.op10_sentence_pieces,
    "op11_sharding": sharding.op11_sharding,
    "op12_whitening": whitening.op12_whitening,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL = {
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op11_sharding": sharding.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
