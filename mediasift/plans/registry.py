"""Registry of named queries over the driver tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function named ``q_*``; ``sql`` is the equivalent statement."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double (adding 0.0 turns -0.0 into 0.0), so results compare exactly."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, places) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else c)
    return df.select(*out)


def R(expr: str, places: int = 6) -> str:
    """SQL text of ``tidy`` for one expression."""
    return f"(round(CAST(({expr}) AS DOUBLE),{places})+0.0)"
