"""Names of the queries, what they run and the SQL that must agree with them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lurewatch.session import prepare
from lurewatch.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables.of(prepare(spark), sf_dir))


QUERIES: dict[str, Query] = {}
# Named sub-selects that oracle texts may refer to by name.
ORACLE_VIEWS: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers ``build(tables) -> DataFrame`` under a name, with the SQL it must equal."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, oracle)
        return build

    return register


def oracle_view(name: str, sql: str) -> str:
    if name in ORACLE_VIEWS:
        raise ValueError(f"oracle view {name} is defined twice")
    ORACLE_VIEWS[name] = sql
    return name


def _names_in(sql: str) -> list[str]:
    words = set(re.findall(r"\bv_\w+", sql))
    return [name for name in ORACLE_VIEWS if name in words]


def oracle_text(sql: str) -> str:
    """The SQL with every view it needs, directly or through another view, put in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _names_in(ORACLE_VIEWS[name]):
            if needed != name and needed not in ordered:
                visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in _names_in(sql):
        visit(name)
    if not ordered:
        return sql
    views = ",\n".join(f"{name} AS MATERIALIZED ({ORACLE_VIEWS[name]})" for name in ordered)
    return f"WITH RECURSIVE {views}\n{sql}"
