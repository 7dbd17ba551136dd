"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontaminate, html_extract, jaccard_join, language_id, line_dedup, packing, phrases, quality_classifier, quality_rules, secret_scan, suffix_dedup, url_filters, vector_codes

QUERIES = {
    "op2_packing": packing.query,
    "op3_decontaminate": decontaminate.query,
    "op1_language_id": language_id.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_line_dedup": line_dedup.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_url_filters": url_filters.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_quality_rules": quality_rules.query,
    "op10_html_extraction": html_extract.query,
    "op11_phrase_mining": phrases.query,
    "op12_secret_scan": secret_scan.query,
    "op13_vector_codes": vector_codes.query,
}

ORACLES: dict[str, str] = {
    "op3_decontaminate": decontaminate.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op11_phrase_mining": phrases.SQL,
    "op12_secret_scan": secret_scan.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
