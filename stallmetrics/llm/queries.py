"""The queries of the operators and their SQL."""

from __future__ import annotations

import importlib

#: Modules of this package that register queries.
MODULES = ("q01", "q02", "q03", "q04", "q05", "q06", "q07", "q08", "q09", "q10", "q11", "q12", "q13")


def _all(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{m}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
