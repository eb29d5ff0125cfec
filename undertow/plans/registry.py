"""Where the checked queries register: a Spark function and, if SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return zone_free(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def zone_free(df: DataFrame) -> DataFrame:
    """Results carry zone-free timestamps, whatever zone the reader lives in."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[
            r(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def R(expression: str, digits: int = 6) -> str:
    """SQL twin of :func:`r`; NaN becomes NULL."""
    return f"(round(CASE WHEN isnan(({expression})::DOUBLE) THEN NULL ELSE ({expression})::DOUBLE END, {digits}) + 0.0::DOUBLE)"
