"""Queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from quarry.llm import bpe, decontaminate, exact_dedup, language_id, line_dedup, lm_scoring, near_dedup, prefix_trie, sessions, sharding, token_counts, toxicity, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": language_id.op3_language_id,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_late_sessions": sessions.op11_late_sessions,
    "op12_warc": warc.op12_warc,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
SQL = {"op5_exact_dedup": exact_dedup.SQL, "op11_late_sessions": sessions.SQL, "op12_warc": warc.SQL, "op13_prefix_trie": prefix_trie.SQL}
