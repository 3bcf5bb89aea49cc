"""All catalogued queries and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

AREAS = ["search", "store", "crm", "graph", "documents", "details", "enrich", "reports"]


def queries() -> dict:
    return {name: fn for area in AREAS for name, fn in import_module(f"kinmatch.catalog.{area}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in import_module(f"kinmatch.catalog.{area}").ORACLES.items()}
