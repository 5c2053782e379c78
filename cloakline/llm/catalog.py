"""Registered queries of this folder and their DuckDB twins."""

from __future__ import annotations

from cloakline.llm import (credentials, exact_dedup, extraction, fingerprints, licenses, mixing, near_dedup, packing, periodic, suffix_dedup,
                           toxicity, warc, whitening)

QUERIES = {
    "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_secret_scan": credentials.op6_secret_scan,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_warc": warc.op9_warc,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_html_extraction": extraction.op12_html_extraction,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_suffix_array_dedup": suffix_dedup.SQL,
    "op7_mix_sources": mixing.SQL,
    "op8_minhash_near_dedup": near_dedup.SQL,
    "op9_warc": warc.SQL,
}
