"""The queries of the text operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from foldwright.llm import bpe, decontaminate, divergence, html, licenses, lm, media, oracle, phrases, pii, quality, secrets, simhash, tokens

QUERIES = {
    "op1_pii_patterns": pii.op1_pii_patterns,
    "op2_media_jpeg": media.op2_media_jpeg,
    "op3_license_scans": licenses.op3_license_scans,
    "op4_byte_level_bpe": bpe.op4_byte_level_bpe,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_secret_scans": secrets.op8_secret_scans,
    "secret_ledger_two_scans": secrets.secret_ledger_two_scans,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_phrase_collocations": phrases.op11_phrase_collocations,
    "op12_token_files": tokens.op12_token_files,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE: dict[str, str] = oracle.ORACLE
