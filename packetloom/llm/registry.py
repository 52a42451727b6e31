"""Queries of the training-data operators, for the driver's entry module."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage with ``query(spark, sf_dir)`` and, where SQL can say it, ``ORACLE``.
MODULES = {
    "op1_simhash_dedup": "simhash",
    "op2_license_scan": "licenses",
    "op3_source_mixing": "mixing",
    "op4_personal_data": "pii",
    "op5_tiered_sharding": "sharding",
    "op6_decontamination": "decontaminate",
    "op7_toxicity": "toxicity",
    "op8_quality_rules": "quality_rules",
    "op9_line_quality": "line_quality",
    "op10_warc_shards": "warc",
    "op11_ranked_search": "search",
    "op12_html_wrappers": "wrappers",
    "op13_spelling_variants": "variants",
}


def queries() -> dict:
    return {name: importlib.import_module(f"packetloom.llm.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"packetloom.llm.{m}"), "ORACLE", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
