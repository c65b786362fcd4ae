"""Queries over the driver's tables, one per operator."""

from __future__ import annotations

import importlib

MODULES = ("scalars", "matching", "assembly", "graphs", "sequences", "linear", "models", "comparisons", "storage", "planar")


def load():
    """(queries, SQL by query name) of all modules."""
    for name in MODULES:
        importlib.import_module(f"workloads.{name}")
    from workloads.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
