"""Training-data operators and their queries. Nothing else in the library imports this package."""

from __future__ import annotations

import importlib

_MODULES = ["quality", "langid", "secrets", "binary", "suffix", "jaccard", "decontaminate", "toxicity", "warc", "packing", "centroids", "neighbours", "whitening"]


def queries() -> dict:
    found = {}
    for name in _MODULES:
        found.update(importlib.import_module(f"{__name__}.{name}").QUERIES)
    return found


def statements() -> dict[str, str]:
    found = {}
    for name in _MODULES:
        found.update(getattr(importlib.import_module(f"{__name__}.{name}"), "STATEMENTS", {}))
    return found
