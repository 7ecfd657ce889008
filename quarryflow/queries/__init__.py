"""Registered queries: one module per section of the operator inventory."""

from __future__ import annotations

import importlib

SECTIONS = ["basics", "shapes", "loads", "products"]


def _collect(name: str) -> dict:
    found: dict = {}
    for section in SECTIONS:
        found |= getattr(importlib.import_module(f"{__name__}.{section}"), name)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
