"""Composed plans: the factor model, the fixtures and the registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "queries_sources", "queries_series", "queries_factors", "queries_selection",
    "queries_risk", "queries_allocation", "queries_replay", "queries_streaming",
)


def load_registry():
    from .oracle import REGISTRY

    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return REGISTRY
