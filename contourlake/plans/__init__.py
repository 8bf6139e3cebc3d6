"""Registered queries over the benchmark tables, with equal SQL."""

from __future__ import annotations

import importlib

MODULES = ("ingest", "inspection", "describe", "editing", "views", "models")


def load():
    """All queries and their SQL."""
    from contourlake.plans.registry import ORACLE_SQL, QUERIES

    for name in MODULES:
        importlib.import_module(f"contourlake.plans.{name}")
    return QUERIES, ORACLE_SQL
