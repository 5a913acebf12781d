"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from tessera.llm import best_fit, byte_bpe, filter_audit, hard_negatives, html_templates, jaccard_join, kneser_ney, license_scan, line_dedup, packing, ppm, projection_forest, quality_rules

QUERIES = {
    "op1_html_templates": html_templates.query,
    "op2_line_dedup": line_dedup.query,
    "op3_ppm": ppm.query,
    "op4_quality_rules": quality_rules.query,
    "op5_kneser_ney": kneser_ney.query,
    "op6_projection_forest": projection_forest.query,
    "op7_byte_bpe": byte_bpe.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_license_scan": license_scan.query,
    "op10_packing": packing.query,
    "op11_filter_audit": filter_audit.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_best_fit": best_fit.query,
}

ORACLE_SQL: dict[str, str] = {"op9_license_scan": license_scan.oracle(), "op11_filter_audit": filter_audit.oracle(), "op12_hard_negatives": hard_negatives.oracle()}
