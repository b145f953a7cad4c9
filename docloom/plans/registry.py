"""All core queries by name, and the SQL that states the same result where SQL can."""

from __future__ import annotations

from . import dedupe, events, feeds, health, policies, reads, texts

MODULES = (feeds, texts, dedupe, events, reads, health, policies)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
