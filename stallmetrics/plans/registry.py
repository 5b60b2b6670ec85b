"""Collects the queries of the plan modules."""

from __future__ import annotations

from . import analysis, control, operations, pages, products, results, streams

_MODULES = (results, analysis, operations, control, pages, products, streams)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}


def flagship(spark, sf_dir: str):
    return results.price_drop(spark, sf_dir)
