"""Registered queries over the test tables and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["basic_queries", "spell_queries", "panel_queries", "effect_queries"]


def registered():
    """All queries and SQL twins by name."""
    from spellpanel.plans.registry import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"spellpanel.plans.{name}")
    return QUERIES, ORACLES
