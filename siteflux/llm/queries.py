"""The registered queries of this package and their SQL."""

from __future__ import annotations

from siteflux.llm import alignment, chat, cotrain, infill, jaccard, lattice, licenses, lines, mixing, packing, rules, simhash, topk

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_top_k": topk.op3_top_k,
    "op4_packing": packing.op4_packing,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_quality_classifier": cotrain.op6_quality_classifier,
    "op7_chat": chat.op7_chat,
    "op8_licenses": licenses.op8_licenses,
    "op9_lattice": lattice.op9_lattice,
    "op10_quality_rules": rules.op10_quality_rules,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_simhash_dedup": simhash.op13_simhash_dedup,
}

ORACLES: dict[str, str] = {
    "op7_chat": chat.OP7_SQL,
    "op3_top_k": topk.OP3_SQL,
    "op5_jaccard_join": jaccard.OP5_SQL,
    "op10_quality_rules": rules.OP10_SQL,
    "op11_fill_in_middle": infill.OP11_SQL,
}
