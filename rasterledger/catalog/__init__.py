"""Registered queries with their SQL counterparts."""

from __future__ import annotations

import importlib

_MODULES = (
    "evaluation",
    "governance",
    "results",
    "rasters",
    "flows",
)


def load_catalog() -> None:
    for name in _MODULES:
        importlib.import_module(f"rasterledger.catalog.{name}")
