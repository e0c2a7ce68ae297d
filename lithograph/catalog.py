"""Every registered query of the engine, with its SQL."""

from __future__ import annotations

import importlib

MODULES = ("graph_queries", "platform_queries", "chat_queries", "text_queries", "rule_queries", "architecture_queries", "stream_queries", "report_queries", "java_queries", "dependency_queries", "odd_queries", "structure_queries", "service_queries")


def _catalogs():
    return [importlib.import_module(f"lithograph.plans.{m}").catalog for m in MODULES]


def queries() -> dict:
    return {name: q for c in _catalogs() for name, q in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for c in _catalogs() for name, s in c.sql.items()}
