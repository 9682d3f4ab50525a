"""The operators' registered queries, and SQL where SQL can express them."""

from __future__ import annotations

from siftstone.llm import ann, chat, decontaminate, filter_audit, lexical, mixing, packing, pii, quality_rules, quality_zstd, simhash, token_cache, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_ann": ann.op2_ann,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality": quality_zstd.op4_quality,
    "op5_token_counts": token_cache.op5_tokens,
    "op6_packing": packing.op6_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_chat": chat.op8_chat,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": quality_rules.op10_rules,
    "op11_decontamination": decontaminate.op11_decontamination,
    "op12_filter_audit": filter_audit.op12_audit,
    "op13_lexical_search": lexical.op13_search,
}

ORACLES = {
    "op8_chat": chat.OP8_SQL,
    "op11_decontamination": decontaminate.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
