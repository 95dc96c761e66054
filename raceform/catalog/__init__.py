"""Queries over the driver tables, one per operator, with SQL twins."""

from __future__ import annotations

from importlib import import_module

from raceform.catalog.registry import QUERIES, SQL, Query

MODULES = ("sources", "projections", "joins", "aggregates", "windows", "reshaping", "functions", "pages", "learning", "flows", "streams")


def _load() -> None:
    for name in MODULES:
        import_module(f"raceform.catalog.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
