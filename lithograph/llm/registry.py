"""The queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

import importlib

from lithograph.plans.tables import shipped

#: Query name -> module that defines it.
MODULES = {
    "op1_url_filter": "urls",
    "op2_warc_round_trip": "warc",
    "op3_ngram_jaccard_join": "jaccard",
    "op4_quality_rules": "quality",
    "op5_language_id": "language",
    "op6_substring_dedup": "substring",
    "op8_weighted_mix": "mixing",
    "op9_benchmark_decontamination": "decontaminate",
    "op10_context_tree_scores": "ctw",
    "op7_suffix_array_dedup": "suffix",
    "op11_merkle_manifest": "merkle",
    "op12_chat_format": "chat",
    "op13_hard_negatives": "negatives",
}


def queries() -> dict:
    return {name: shipped(getattr(importlib.import_module(f"lithograph.llm.{module}"), name)) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in sorted(set(MODULES.values())):
        out |= getattr(importlib.import_module(f"lithograph.llm.{module}"), "ORACLE_SQL", {})
    return out
