"""Queries of the corpus operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pathloom.llm import decontaminate, html, licenses, near, packing, sharding, substrings, token_counts, topk, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_sharding": sharding.op2_sharding,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_html_extraction": html.op6_html_extraction,
    "op7_minhash": near.op7_minhash,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_top_k": topk.op9_top_k,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_substring_dedup": substrings.ORACLE,
    "op7_minhash": near.ORACLE,
    "op9_top_k": topk.ORACLE,
}
