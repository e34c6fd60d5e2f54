"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import exact_dedup, importance, minhash_dedup, mixing, pieces, pii, quality_rules, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_importance": importance.op3_importance,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_pii": pii.op5_pii,
    "op6_pieces": pieces.op6_pieces,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
}

ORACLES = {
    "op7_exact_dedup": exact_dedup.ORACLE,
}
