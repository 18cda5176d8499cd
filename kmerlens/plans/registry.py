"""The list of queries: every entry pairs a DataFrame plan with its DuckDB text, where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(plan: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if oracle:
            ORACLE_SQL[name] = oracle
        return plan

    return add


def r6(c: str | Column) -> Column:
    """Rounded as the DuckDB twin rounds; the name is kept."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df, *names: str):
    for n in names:
        df = df.withColumn(n, r6(n))
    return df
