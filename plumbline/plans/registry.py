"""The registered queries: name, Spark callable, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIGITS = 6

# Added before rounding, so that values half-way between two results go the same way in both
# engines, whichever side of the half the last bit falls on.
NUDGE = 1e-10


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of digits, without negative zeros."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c) + F.lit(NUDGE), DIGITS) + F.lit(0.0) for c in doubles}) if doubles else df
