"""Registered queries with their oracle SQL, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ["security", "facts", "graph", "coverage", "conventions", "context", "advisories", "patterns", "architecture", "streaming"]


def load():
    """All registered queries by name."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    from .registry import REGISTRY

    return REGISTRY
