"""Query registry and the rounding both engines share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Both engines round after adding this shift, so that a value half-way between two
# roundings (means of short decimals often are) cannot fall on different sides.
SHIFT = round(math.pi * 1e-6, 20)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r(column: str | Column, digits: int = 4) -> Column:
    if isinstance(column, str):
        return F.expr(f"round(`{column}` + {SHIFT!r}D, {digits})")
    return F.round(column + F.lit(SHIFT), digits)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.withColumns(
        {f.name: r(f.name, digits) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    )


def sr(expression: str, alias: str | None = None, digits: int = 4) -> str:
    """SQL text of the same rounding."""
    text = f"round(CAST({expression} AS DOUBLE) + {SHIFT!r}, {digits})"
    return f"{text} AS {alias}" if alias else text
