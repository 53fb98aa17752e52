"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from shelfscope.catalog import listings, market, matching, pages

MODULES = [pages, listings, matching, market]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
