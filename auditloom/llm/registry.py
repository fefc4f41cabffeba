"""Queries of the operators in this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, divergence, neardup, packing, pii, quality, shards, suffix, tokencounts, toxicity, urls, whitening

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_minhash_neardup": neardup.op3_minhash_neardup,
    "op4_sharding": shards.op4_sharding,
    "op5_token_counts": tokencounts.op5_token_counts,
    "op6_url_filters": urls.op6_url_filters,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_suffix_dedup": suffix.op10_suffix_dedup,
    "op11_pii": pii.op11_pii,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op3_minhash_neardup": neardup.OP3_SQL,
    "op4_sharding": shards.OP4_SQL,
    "op6_url_filters": urls.OP6_SQL,
    "op10_suffix_dedup": suffix.OP10_SQL,
    "op11_pii": pii.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
