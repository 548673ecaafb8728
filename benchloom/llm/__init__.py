"""Operators of a training-data pipeline.  Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

MODULES = [
    "line_dedup",
    "toxicity",
    "embedding_dedup",
    "sharding",
    "decontamination",
    "token_files",
    "packing",
    "pseudonyms",
    "simhash_dedup",
    "suffix_dedup",
    "divergence_audit",
    "centroid_clusters",
    "source_mix",
]


def all_queries():
    """The query of every operator, by name."""
    found = {}
    for module in MODULES:
        found.update(importlib.import_module(f"benchloom.llm.{module}").QUERIES)
    return found


def all_oracles():
    """The SQL of every operator that SQL can express, by query name."""
    found = {}
    for module in MODULES:
        found.update(getattr(importlib.import_module(f"benchloom.llm.{module}"), "ORACLES", {}))
    return found
