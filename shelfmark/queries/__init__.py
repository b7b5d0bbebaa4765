"""Registry of the core queries and their SQL equivalents."""

from __future__ import annotations

from shelfmark.queries import general, more, pipeline, reports, writeback

MODULES = (general, reports, pipeline, more, writeback)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
