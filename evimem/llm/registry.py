"""All queries of this subpackage with their SQL."""

from __future__ import annotations

from evimem.llm import queries as _q

MODULES = (_q,)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
