"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import best_fit_packing, decontaminate, hard_negatives, jaccard_join, language_id, quality_model, sentence_pieces, source_divergence, substring_dedup, suffix_dedup, token_counts, topk_search, warc_revisit


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_language_id": language_id.op2_language_id,
        "op3_warc_revisit": warc_revisit.op3_warc_revisit,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_best_fit_packing": best_fit_packing.op5_best_fit_packing,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_quality_model": quality_model.op7_quality_model,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_topk_search": topk_search.op10_topk_search,
        "op11_source_divergence": source_divergence.op11_source_divergence,
        "op12_sentence_pieces": sentence_pieces.op12_sentence_pieces,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_revisit": warc_revisit.OP3_SQL,
        "op10_topk_search": topk_search.OP10_SQL,
        "op11_source_divergence": source_divergence.OP11_SQL,
        "op13_hard_negatives": hard_negatives.OP13_SQL,
    }
