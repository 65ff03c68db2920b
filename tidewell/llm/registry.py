"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, language_id, line_dedup, lz_fingerprint, ngram_join, packing, quote_links, secrets_scan, sharding, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_quotation_linking": quote_links.op2_quotation_linking,
    "op3_lz_fingerprints": lz_fingerprint.op3_lz_fingerprints,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_language_id": language_id.op5_language_id,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_sharding": sharding.op7_sharding,
    "op8_secret_scans": secrets_scan.op8_secret_scans,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE_SQL = {
    "op4_decontamination": decontaminate.ORACLE_OP4,
    "op6_ngram_join": ngram_join.ORACLE_OP6,
    "op7_sharding": sharding.ORACLE_OP7,
    "op8_secret_scans": secrets_scan.ORACLE_OP8,
    "op10_line_dedup": line_dedup.ORACLE_OP10,
}
