"""All queries of the subpackage with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("validity", "origin", "fusion", "docpairs", "splitting", "tokens", "packing", "repetition")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").SQL.items()}
