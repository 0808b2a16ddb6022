"""Registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality_queries", "mart_queries", "feature_queries", "model_queries", "governance_queries", "learning_queries", "stream_queries", "file_queries")


def load_queries():
    """All registered queries by name."""
    for module in MODULES:
        import_module(f"voltmill.plans.{module}")
    from voltmill.plans.registry import QUERIES

    return QUERIES
