"""Registered queries over the TPC-H-like test tables, each with equivalent ANSI SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from concord.plans.registry import ORACLES, QUERIES

_MODULES = ("compare", "jobs", "lifecycle", "resolution", "validation", "reports", "streams")


def _load() -> None:
    for module in _MODULES:
        import_module(f"{__name__}.{module}")


def registered() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
