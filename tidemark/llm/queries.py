"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import chat, decontaminate, exact, language, lines, mixing, near, packing, quality, repair, substring, suffixes, survivors

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_language_id": language.op3_language_id,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_suffix_array_dedup": suffixes.op8_suffix_array_dedup,
    "op9_minhash_near_dedup": near.op9_minhash_near_dedup,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_filter_interactions": survivors.op12_filter_interactions,
    "op13_source_mixing": mixing.op13_source_mixing,
}
ORACLES = {
    "op1_substring_dedup": substring.OP1_SQL,
    "op2_exact_dedup": exact.OP2_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op5_chat_formatting": chat.OP5_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
    "op11_structure_repair": repair.OP11_SQL,
    "op12_filter_interactions": survivors.OP12_SQL,
    "op13_source_mixing": mixing.OP13_SQL,
}
