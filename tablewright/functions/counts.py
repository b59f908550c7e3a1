"""Cells of many columns as distinct values with their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency of every non-null value, all columns in one shuffle with map-side counts."""
    strings = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (strings.unpivot([], list(columns), "column", "value").where("value IS NOT NULL")
            .groupBy("column", "value").agg(F.count("*").alias("count")))


def cells_where(condition: Column) -> Column:
    """Aggregate over value counts: how many cells meet a condition."""
    return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))
