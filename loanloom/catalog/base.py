"""Registry of queries and the SQL text each result must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanloom.functions.guards import HALF_SHIFT, rounded
from loanloom.sources.star import VIEWS, StarTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, digits: int | None = 6):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def wrap(build: Callable[[StarTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = build(StarTables(spark, folder))
            return result if digits is None else rounded(result, digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return wrap


def with_tables(select: str, *views: str, **ctes: str) -> str:
    """``select`` preceded by the named loan views and further common tables."""
    parts = [f"{v} AS ({VIEWS[v][1].strip()})" for v in views]
    parts += [f"{name} AS ({text.strip()})" for name, text in ctes.items()]
    return f"WITH {', '.join(parts)}\n{select.strip()}"


def r6(expr: str, name: str, digits: int = 6) -> str:
    """Rounded double, shifted like :func:`loanloom.functions.guards.rounded`."""
    return f"round(CAST({expr} AS DOUBLE) + CAST({HALF_SHIFT!r} AS DOUBLE), {digits}) AS {name}"
