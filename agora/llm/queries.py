"""Registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from agora.llm import alignment, chat, lines, mixing, near_dup, packing, quality, sentencepiece, spelling, substring, suffix_array, topk, toxicity

QUERIES = {
    "op3_suffix_array": suffix_array.op3_suffix_array,
    "op6_substring": substring.op6_substring,
    "op2_toxicity": toxicity.op2_toxicity,
    "op4_topk": topk.op4_topk,
    "op7_chat_format": chat.op7_chat_format,
    "op5_sentencepiece": sentencepiece.op5_sentencepiece,
    "op1_quality": quality.op1_quality,
    "op10_mixing": mixing.op10_mixing,
    "op8_near_dup": near_dup.op8_near_dup,
    "op9_line_dedup": lines.op9_line_dedup,
    "op11_spelling": spelling.op11_spelling,
    "op12_packing": packing.op12_packing,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE = {
    "op6_substring": substring.OP6_SQL,
    "op4_topk": topk.OP4_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op1_quality": quality.OP1_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op11_spelling": spelling.OP11_SQL,
}
