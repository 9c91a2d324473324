"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from lexloom.llm import ball_tree, decontaminate, embedding_dedup, gated_lm, jaccard_join, line_dedup, prefix_forest, quality, source_mix, token_planes, toxicity, url_filter, whitening

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality": quality.op3_quality,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_lm_score": gated_lm.op5_lm_score,
    "op6_token_ids": token_planes.op6_token_ids,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_prefix_forest": prefix_forest.op8_prefix_forest,
    "op9_source_mix": source_mix.op9_source_mix,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_ball_tree": ball_tree.op11_ball_tree,
    "op12_whitening": whitening.op12_whitening,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
    "source_mix_targets": source_mix.source_mix_targets,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_ball_tree": ball_tree.ORACLE,
    "op13_embedding_dedup": embedding_dedup.ORACLE,
    "source_mix_targets": source_mix.TARGETS_ORACLE,
}
