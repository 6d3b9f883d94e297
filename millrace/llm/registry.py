"""Queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from millrace.llm import chat, decontaminate, extract, idfiles, jaccard, licenses, packing, quality, topk, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_license_scans": licenses.op2_license_scans,
    "op3_token_files": idfiles.op3_token_files,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_extraction": extract.op9_html_extraction,
    "op10_exact_topk": topk.op10_exact_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scans": licenses.oracle(),
    "op4_ngram_jaccard_join": jaccard.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op7_chat_formatting": chat.ORACLE,
    "op10_exact_topk": topk.ORACLE,
}
