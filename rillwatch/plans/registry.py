"""The table of registered queries: a name, a function (spark, folder) -> DataFrame, and the same query as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison: sums of doubles depend on the order of the rows."""
    return F.round(c if isinstance(c, Column) else F.col(c), digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def sql_rnd(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"
