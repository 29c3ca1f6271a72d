"""Queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from . import ann, bpe, chat, exact_dedup, licenses, near_dedup, packing, pii, token_counts, toxicity

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_near_duplicates": near_dedup.op3_near_duplicates,
    "op4_packing": packing.op4_packing,
    "op5_nearest": ann.op5_nearest,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "exact_dedup_history": exact_dedup.exact_dedup_history,
    "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
    "op8_pii": pii.op8_pii,
    "op9_preferences": chat.op9_preferences,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE_SQL = {"op6_exact_dedup": exact_dedup.OP6_SQL, "exact_dedup_history": exact_dedup.HISTORY_SQL, "op9_preferences": chat.OP9_SQL}
