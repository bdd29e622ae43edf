"""Registered queries by area, each with the SQL statement of its result where one exists."""

from __future__ import annotations

import importlib

AREAS = ["windows", "attacks", "scores", "quality", "models", "streams", "files", "neighbours", "assembly", "provenance", "forecasts"]


def _areas():
    return [importlib.import_module(f"netstate.catalog.{area}") for area in AREAS]


def all_queries() -> dict:
    return {name: function for area in _areas() for name, function in area.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for area in _areas() for name, sql in area.ORACLE.items()}
