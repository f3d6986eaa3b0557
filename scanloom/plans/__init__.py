"""Registered queries over the supplied tables."""

from __future__ import annotations

import importlib

from scanloom import registry

MODULES = ["catalogue", "artefacts", "exports", "scalars", "quads", "streams", "raster", "raster_area", "raster_filters"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"scanloom.plans.{name}")


def all_queries():
    _load()
    return dict(registry.QUERIES)


def all_oracles():
    _load()
    return dict(registry.ORACLES)
