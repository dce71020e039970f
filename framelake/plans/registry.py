"""The queries by name, each with the same in DuckDB's SQL where SQL can say it, and how both sides round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FOCAL, MOVE, MAX_DISPARITY = 50.0, (0.5, 0.0, 0.25), 16.0
PIXEL = ["video", "frame", "y", "x"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


#: Added before rounding where values have few binary digits and would lie on the edge between two decimals.
NUDGE = 1.7e-9


def nudged(c, name: str, digits: int = 6):
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE * 10 ** (6 - digits), digits).alias(name)


def nudged_sql(c: str, name: str, digits: int = 6) -> str:
    return f"round({c} + {NUDGE * 10 ** (6 - digits)!r}::DOUBLE, {digits}) AS {name}"


def r6s(*names: str):
    return [r6(n, n) for n in names]
