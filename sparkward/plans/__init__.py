"""Registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "access", "masked", "results", "changes", "relational", "scalar", "auditing", "enforcing", "live",
)


def load_all():
    """Import every module of queries; returns (queries, oracle SQL)."""
    from sparkward.plans import registry

    for name in MODULES:
        import_module(f"sparkward.plans.{name}")
    return registry.QUERIES, registry.ORACLE
