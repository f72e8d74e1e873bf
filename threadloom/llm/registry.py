"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import chat, crossing, decontaminate, language, negatives, neighbours, packing, pii, simhash, suffix_dedup, tokens, toxicity, url_filter

QUERIES = {
    "op1_vantage_point_neighbours": neighbours.op1_vantage_point_neighbours,
    "op2_columnwise_suffix_dedup": suffix_dedup.op2_columnwise_suffix_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_reply_tree_chat": chat.op4_reply_tree_chat,
    "op5_multiple_instance_toxicity": toxicity.op5_multiple_instance_toxicity,
    "op6_seed_alignment_decontamination": decontaminate.op6_seed_alignment_decontamination,
    "op7_string_kernel_language": language.op7_string_kernel_language,
    "op8_boosted_candidates_pii": pii.op8_boosted_candidates_pii,
    "op9_simhash_components": simhash.op9_simhash_components,
    "op10_temporal_url_filter": url_filter.op10_temporal_url_filter,
    "op11_token_lists": tokens.op11_token_lists,
    "op12_angular_hard_negatives": negatives.op12_angular_hard_negatives,
    "op13_shared_cut_alignment": crossing.op13_shared_cut_alignment,
}
SQL = {"op4_reply_tree_chat": chat.SQL, "op10_temporal_url_filter": url_filter.SQL}
