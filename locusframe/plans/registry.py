"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, body: str | None = None, extra: str = ""):
    """Register a query and, where SQL expresses it, its SQL over the derived tables."""

    def add(f):
        QUERIES[name] = f
        if body is not None:
            ORACLE_SQL[name] = sql(body, extra)
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """``df`` with some columns rounded, so that the order of a sum does not show."""
    return df.withColumns({n: F.round(n, digits) for n in names})


def rnd(c: str, digits: int = 6) -> str:
    """The same in SQL, without a negative zero."""
    return f"(round({c}, {digits}) + 0)"
