"""Registered queries over the given tables, and the same in SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("temporal", "facts", "retrieval", "curation", "context", "streams")


def queries():
    return {n: f for m in _MODULES for n, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql():
    return {n: s for m in _MODULES for n, s in import_module(f"{__name__}.{m}").SQL.items()}
