"""All queries of the core with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = (
    "operators.ranking", "operators.lookup", "operators.traverse", "operators.references", "plans.planner", "operators.stats", "operators.vector", "operators.changes", "operators.chunking", "operators.projects", "operators.imports", "operators.linking", "sources.parsers", "sources.types", "streaming.watch", "operators.hierarchy", "operators.orphans",
)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"sparkloom.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"sparkloom.{m}").SQL.items()}
