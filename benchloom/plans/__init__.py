"""Every operator bound to the given tables."""

from __future__ import annotations

import importlib

MODULES = ["runs", "extraction", "scoring", "joins", "measure", "quality", "training", "market", "inventory", "sources", "streaming"]


def _load():
    for module in MODULES:
        importlib.import_module(f"benchloom.plans.{module}")
    from benchloom.plans import registry

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
