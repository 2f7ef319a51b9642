"""Registered queries (one per operator of the inventory) and their DuckDB oracle SQL."""

from __future__ import annotations

from . import charts, events, facets, files, store, text

_MODULES = [charts, store, facets, text, events, files]


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.SQL)
    return out
