"""Registered queries over the driver tables, each next to its DuckDB statement."""

from __future__ import annotations

import importlib

from . import registry

_MODULES = ["text", "validate", "agreement", "stats", "joins", "retrieval", "corpus", "runs"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.q_{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def statements():
    _load()
    return dict(registry.STATEMENTS)
