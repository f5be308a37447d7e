"""Queries and reference SQL of the training-data operators, by name."""

from __future__ import annotations

from strophe.llm import chat_format, decontaminate, html_extract, license_scan, line_dedup, media, ngram_join, packing, secrets, toxicity

MODULES = {
    "op1_line_dedup": line_dedup,
    "op2_secret_scans": secrets,
    "op3_toxicity": toxicity,
    "op4_media_columns": media,
    "op5_chat_formatting": chat_format,
    "op6_packing": packing,
    "op7_ngram_jaccard_join": ngram_join,
    "op8_benchmark_decontamination": decontaminate,
    "op9_license_scans": license_scan,
    "op10_html_extraction": html_extract,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in MODULES.items() if getattr(m, "SQL", None)}
