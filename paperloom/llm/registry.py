"""The queries of this subpackage and, where SQL can express one, the same in SQL."""

from __future__ import annotations

from . import decontamination, divergence, exact_dedup, filter_audit, jaccard_join, mixing, packing, paragraph_dedup, quality, secret_scan, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_mixing": mixing.query,
    "op4_best_fit_packing": packing.query,
    "op5_quality_rules": quality.query,
    "op6_jaccard_join": jaccard_join.query,
    "op7_url_filters": url_filter.query,
    "op8_substring_dedup": paragraph_dedup.query,
    "op9_secret_scans": secret_scan.query,
    "op10_toxicity": toxicity.query,
    "op11_decontamination": decontamination.query,
    "op12_filter_audit": filter_audit.query,
    "op13_source_divergence": divergence.query,
}
SQL = {"op1_exact_dedup": exact_dedup.SQL, "op11_decontamination": decontamination.SQL, "op12_filter_audit": filter_audit.SQL, "op13_source_divergence": divergence.SQL}
