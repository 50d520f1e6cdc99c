"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = [
    "timeline_queries", "text_queries", "record_queries", "quality_queries", "stream_queries",
    "source_queries",
]


def _merge(name: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        part = getattr(importlib.import_module(f"spanalign.plans.{module}"), name)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged |= part
    return merged


def queries() -> dict:
    return _merge("QUERIES")


def oracle_sql() -> dict:
    return _merge("SQL")
