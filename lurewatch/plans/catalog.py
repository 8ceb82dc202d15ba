"""All named queries."""

from __future__ import annotations

import importlib

from lurewatch.plans.registry import QUERIES, Query, oracle_text

MODULES = ("sql", "detection", "campaigns", "scalars", "incidents", "response", "learning", "live")


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"lurewatch.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: oracle_text(q.oracle) for name, q in QUERIES.items() if q.oracle is not None}
