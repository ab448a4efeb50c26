"""Registry of the corpus operators: queries, and SQL where SQL can express them."""

from __future__ import annotations

from . import conversations, decontaminate, fingerprints, history, language_id, lm_score, ngram_join, quality_rules, sentence_pieces, sharding, substring_dedup, url_filter, warc


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_language_id": language_id.op2_language_id,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_sharding": sharding.op6_sharding,
        "op7_sentencepiece": sentence_pieces.op7_sentencepiece,
        "op8_warc": warc.op8_warc,
        "op9_lm_score": lm_score.op9_lm_score,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_history": history.op11_history,
        "op12_fingerprints": fingerprints.op12_fingerprints,
        "op13_conversations": conversations.op13_conversations,
        "quality_ablation": quality_rules.quality_ablation,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE_SQL,
        "op4_decontamination": decontaminate.ORACLE_SQL,
        "op5_substring_dedup": substring_dedup.ORACLE_SQL,
        "op6_sharding": sharding.ORACLE_SQL,
        "op8_warc": warc.ORACLE_SQL,
        "op11_history": history.ORACLE_SQL,
        "op13_conversations": conversations.ORACLE_SQL,
        "quality_ablation": quality_rules.ABLATION_SQL,
    }
