"""Registered queries: each one is a Spark plan over the driver tables plus, where SQL can say it, the same in SQL."""

from __future__ import annotations

from reachgrid.plans import registry


def load() -> registry.Registry:
    """Import every plan module and return the filled registry."""
    from reachgrid.plans import (  # noqa: F401
        access, census, cubes, feeds, impact, prices, shaping, spatial, stats, timetable)
    return registry.REGISTRY
