"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, language_model, license_scans, mixing, near_dedup, spot_signatures, token_counts, token_ids, toxicity, url_filters

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_token_ids": token_ids.op5_token_ids,
    "op6_license_scans": license_scans.op6_license_scans,
    "op7_fingerprints": spot_signatures.op7_fingerprints,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_language_model": language_model.op10_language_model,
}
ORACLE_SQL = {
    "op1_source_mix": mixing.OP1_SQL,
    "op2_url_filters": url_filters.OP2_SQL,
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op6_license_scans": license_scans.OP6_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
}
