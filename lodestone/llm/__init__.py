"""Operators for preparing training corpora; nothing else in the library imports this package."""

from __future__ import annotations

from . import covertree, divergence, fingerprints, licences, manifest, mixing, packing, partenum, quality, secret_scan, templates, toxicity, warc

QUERIES = {
    "op1_ngram_jaccard_join": partenum.op1_ngram_jaccard_join,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_secret_scans": secret_scan.op4_secret_scans,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_document_fingerprints": fingerprints.op6_document_fingerprints,
    "op7_exact_top_k_search": covertree.op7_exact_top_k_search,
    "op8_warc": warc.op8_warc,
    "op9_license_scans": licences.op9_license_scans,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_html_extraction": templates.op11_html_extraction,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLES = {"op1_ngram_jaccard_join": partenum.ORACLE, "op4_secret_scans": secret_scan.ORACLE, "op7_exact_top_k_search": covertree.ORACLE, "op8_warc": warc.ORACLE, "op9_license_scans": licences.ORACLE, "op12_merkle_manifest": manifest.ORACLE, "op13_source_divergence": divergence.ORACLE}
