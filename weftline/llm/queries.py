"""The registered training-data queries and their DuckDB SQL where SQL can express them. The pipeline of corpus_pipeline.py is registered beside them."""

from __future__ import annotations

from . import languages, licenses, line_dedup, merkle, mixing, near_dedup, packing, periodic, quality_cnn, quality_rules, suffix_dedup, token_files, winnowing


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_fingerprints": winnowing.op2_fingerprints,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_packing": packing.op5_packing,
        "op6_language_mixture": languages.op6_language_mixture,
        "op7_token_files": token_files.op7_token_files,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_quality_cnn": quality_cnn.op10_quality_cnn,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict:
    return {"op4_line_dedup": line_dedup.SQL, "op12_suffix_dedup": suffix_dedup.SQL, "op13_merkle_manifest": merkle.SQL}
