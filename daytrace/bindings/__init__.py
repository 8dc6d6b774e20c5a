"""Binding of the operators to the driver's tables: views, queries and their SQL statements."""

from __future__ import annotations

import importlib

MODULES = ("day_queries", "episode_queries", "event_queries", "text_queries", "review_queries", "source_queries", "audit_queries")


def load():
    """(queries, SQL) of all binding modules."""
    from daytrace.bindings import registry

    for name in MODULES:
        importlib.import_module(f"daytrace.bindings.{name}")
    return registry.QUERIES, registry.SQL
