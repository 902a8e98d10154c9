"""Query registration: one decorator, one dict of Spark queries, one of DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(c: Column | str, places: int = 4) -> Column:
    """Rounded double without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), places) + F.lit(0.0)


def pick(df: DataFrame, keys: list[str], rounded: list[str] = (), places: int = 4) -> DataFrame:
    return df.select(*keys, *[rnd(c, places).alias(c) for c in rounded])


def r(expr: str, alias: str | None = None, places: int = 4) -> str:
    """The same rounding in SQL."""
    return f"round(({expr})::double, {places}) + 0.0 as {alias or expr}"


def rs(*cols: str, places: int = 4) -> str:
    return ", ".join(r(c, c, places) for c in cols)
