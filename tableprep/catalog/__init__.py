"""The registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from tableprep.catalog.common import Query

MODULES = ("profiles", "assessments", "transforms", "logs", "texts", "flows")


def all_queries() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for module in MODULES:
        found |= import_module(f"tableprep.catalog.{module}").QUERIES
    return found
