"""Registered queries: each has a name, a Spark callable and, where SQL can say it,
an equivalent DuckDB statement over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Six digits, never a negative zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, 6) + F.lit(0.0)


def sql_r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"
