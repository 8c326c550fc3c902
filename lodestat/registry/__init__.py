"""Every operator as a query over the given tables, with its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("cleaning", "profiling", "statistics", "anomalies", "charting", "modelling", "forecasting", "properties")


def entries() -> dict:
    """{name: (query, sql or None)} of all families."""
    found = {}
    for name in _MODULES:
        found |= import_module(f"lodestat.registry.{name}").ENTRIES
    return found
