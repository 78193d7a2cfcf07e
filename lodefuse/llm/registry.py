"""Queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

import importlib

#: Module by query.
MODULES = {
    "op1_best_fit_packing": "packing",
    "op2_toxicity": "toxicity",
    "op3_mixing_sources": "mixing",
    "op4_media_columns": "media",
    "op5_simhash_near_dedup": "simhash",
    "op6_quality_classifier": "quality",
    "op7_pii": "pii",
    "op8_winnowing": "winnowing",
    "op9_warc": "warc",
    "op10_substring_dedup": "substrings",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"lodefuse.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"lodefuse.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
