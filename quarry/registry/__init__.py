"""Registered queries: each names its operators, its Spark form and its check SQL."""

from __future__ import annotations

from importlib import import_module

from quarry.registry.catalog import CATALOG

for _area in ("search", "chunks", "evaluate", "graph", "documents", "conversations", "textfields", "streams", "chain", "tables"):
    import_module(f"quarry.registry.{_area}")

__all__ = ["CATALOG"]
