"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import queries_chat, queries_dedup, queries_manifest, queries_native, queries_repeats, queries_spelling, queries_tokens, queries_toxicity, queries_warc

QUERIES = {
    "op1_warc": queries_warc.op1_warc,
    "op2_suffix_array_dedup": queries_repeats.op2_suffix_array_dedup,
    "op3_toxicity": queries_toxicity.op3_toxicity,
    "op4_edit_token_counts": queries_tokens.op4_edit_token_counts,
    "op5_minhash_near_dedup": queries_dedup.op5_minhash_near_dedup,
    "op6_mix_sources": queries_native.op6_mix_sources,
    "op7_embedding_near_dedup": queries_dedup.op7_embedding_near_dedup,
    "op8_quality_rules": queries_native.op8_quality_rules,
    "op9_bpe_round_trip": queries_tokens.op9_bpe_round_trip,
    "op10_automaton_dedup": queries_repeats.op10_automaton_dedup,
    "op11_merkle_manifest": queries_manifest.op11_merkle_manifest,
    "op12_spelling_variants": queries_spelling.op12_spelling_variants,
    "op13_chat_format": queries_chat.op13_chat_format,
}

SQL = {
    "op1_warc": queries_warc.OP1_SQL,
    "op2_suffix_array_dedup": queries_repeats.OP2_SQL,
    "op5_minhash_near_dedup": queries_dedup.OP5_SQL,
    "op6_mix_sources": queries_native.OP6_SQL,
    "op7_embedding_near_dedup": queries_dedup.OP7_SQL,
    "op10_automaton_dedup": queries_repeats.OP10_SQL,
    "op11_merkle_manifest": queries_manifest.OP11_SQL,
    "op12_spelling_variants": queries_spelling.OP12_SQL,
    "op13_chat_format": queries_chat.OP13_SQL,
}
