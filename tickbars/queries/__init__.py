"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("bar_queries", "wire_queries", "quality_queries", "log_queries", "stream_queries")


def all_queries() -> dict:
    found: dict = {}
    for m in _MODULES:
        found.update(import_module(f"tickbars.queries.{m}").QUERIES)
    return found


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _MODULES:
        found.update(import_module(f"tickbars.queries.{m}").SQL)
    return found
