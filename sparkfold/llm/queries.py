"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from sparkfold.llm import clause_grammar, html_wrapper, license_scan, line_dedup, maxent_lm, mixing, mpeg_audio, near_dedup, prefix_viterbi, quality_forest

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": clause_grammar.op2_toxicity,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_html_wrapper": html_wrapper.op4_html_wrapper,
    "op5_prefix_viterbi": prefix_viterbi.op5_prefix_viterbi,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_maxent_lm": maxent_lm.op7_maxent_lm,
    "op8_mpeg_audio": mpeg_audio.op8_mpeg_audio,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality_forest": quality_forest.op10_quality_forest,
}
SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
}
