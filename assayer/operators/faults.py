"""Deterministic faults, decided by key values and never by row position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expr import data_type, quoted

# fixed values: the injected extreme, and the constant column for tables without numbers
EXTREME_VALUE = 999999.99
FILLER_COLUMN, FILLER_VALUE = "freight_value", 15.50


def inject_missing(df: DataFrame, column: str, key: str, period: int = 5,
                   blank: str | None = None) -> DataFrame:
    """Empty ``column`` (null, or the given blank text) where key % period = 0."""
    hole = F.lit(blank).cast(data_type(df, column))
    return df.withColumn(column, F.when(F.pmod(quoted(key), F.lit(period)) == 0, hole)
                         .otherwise(quoted(column)))


def inject_duplicates(df: DataFrame, condition: Column) -> DataFrame:
    """Append a second copy of the rows that meet ``condition``."""
    return df.unionByName(df.where(condition))


def inject_schema_drift(df: DataFrame, column: str | None = None) -> DataFrame:
    return df.drop(column or df.columns[-1])


def inject_outliers(df: DataFrame, key: str, bound: int = 5, column: str | None = None,
                    value: float = EXTREME_VALUE) -> DataFrame:
    """Write an extreme into ``column`` where key < bound."""
    if column is None:
        column = FILLER_COLUMN
        df = df.withColumn(column, F.lit(FILLER_VALUE))
    return df.withColumn(column, F.when(quoted(key) < bound, F.lit(value))
                         .otherwise(quoted(column).cast("double")))
