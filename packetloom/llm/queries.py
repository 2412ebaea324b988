"""The corpus queries and their SQL."""

from __future__ import annotations

from packetloom.llm import bpe, chat, exact_dedup, filter_audit, lexical, mixing, mtree, pitman_yor, simhash, suffix_dedup, token_counts, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1,
        "op2_exact_top_k": mtree.op2,
        "op3_chat_formatting": chat.op3,
        "op4_exact_dedup": exact_dedup.op4,
        "op5_byte_bpe": bpe.op5,
        "op6_token_counts": token_counts.op6,
        "op7_source_mixing": mixing.op7,
        "op8_toxicity": toxicity.op8,
        "op9_url_filters": url_filter.op9,
        "op10_simhash_near_dedup": simhash.op10,
        "op11_pitman_yor": pitman_yor.op11,
        "op12_filter_audit": filter_audit.op12,
        "op13_lexical_search": lexical.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_top_k": mtree.ORACLE,
        "op3_chat_formatting": chat.ORACLE,
        "op4_exact_dedup": exact_dedup.ORACLE,
        "op7_source_mixing": mixing.ORACLE,
        "op9_url_filters": url_filter.ORACLE,
        "op12_filter_audit": filter_audit.ORACLE,
        "op13_lexical_search": lexical.ORACLE,
    }
