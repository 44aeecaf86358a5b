"""The list of checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    query: Query
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can say the same."""

    def register(query: Query) -> Query:
        key = name or query.__name__
        if key in CHECKS:
            raise ValueError(f"two checks named {key}")
        CHECKS[key] = Check(query, sql)
        return query

    return register
