"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat_format, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, lm_score, periodic_runs, quality, simhash, substring_dedup, vector_code


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_language_id": language_id.op4_language_id,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_simhash": simhash.op9_simhash,
        "op10_katz_score": lm_score.op10_katz_score,
        "op11_jaccard_join": jaccard_join.op11_jaccard_join,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_vector_code": vector_code.op13_vector_code,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.SQL,
        "op3_exact_dedup": exact_dedup.SQL,
        "op5_decontaminate": decontaminate.SQL,
        "op6_chat_format": chat_format.SQL,
        "op7_line_dedup": line_dedup.SQL,
        "op11_jaccard_join": jaccard_join.SQL,
        "op13_vector_code": vector_code.SQL,
    }
