"""Query registry: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def rounded(value: str, digits: int) -> str:
    """SQL rounding of the shortest decimal form of a double, half up, as Spark rounds."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(30, 18)), {digits}) AS DOUBLE)"


def _with(needs: tuple[str, ...], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(
        f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in ordered) + f"\n{body}"


def query(name: str, needs: tuple[str, ...] = (), sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = _with(needs, sql)
        return fn
    return register
