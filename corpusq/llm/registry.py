"""Queries of this package and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from corpusq.llm import decontaminate, filter_audit, forest, license_scan, line_dedup, merkle, mix, neardup, perspectives, quality, secret_scan, tokens, warc

QUERIES = {
    "op1_mix_sources": mix.op1_mix_sources,
    "op2_revisits": warc.op2_revisits,
    "op3_nearest": forest.op3_nearest,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_licenses": license_scan.op5_licenses,
    "op6_token_files": tokens.op6_token_files,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_perspectives": perspectives.op9_perspectives,
    "op10_quality": quality.op10_quality,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op1_mix_sources": mix.ORACLE_SQL,
    "op2_revisits": warc.ORACLE_SQL,
    "op5_licenses": license_scan.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
    "op9_perspectives": perspectives.ORACLE_SQL,
    "op11_line_dedup": line_dedup.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
