"""Exact duplicates: counting, full-row removal and gated removal by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one, nulls equal to nulls."""
    return (df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long")
                 .alias("duplicate_rows")))


def drop_full_duplicates(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row per distinct content; with a row id, the copy holding the smallest stays."""
    if row_id is None:
        return df.dropDuplicates()
    content = [c for c in df.columns if c != row_id]
    return df.groupBy(*content).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def id_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if c.endswith("_id") or c == "id"), None)


def id_gate(df: DataFrame, column: str) -> DataFrame:
    """Whether an id may serve as a key: nearly unique, and few rows would go."""
    per_id = (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")))
    measured = per_id.agg(F.count("*").alias("distinct_ids"),
                          F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_with_id"))
    unique = F.coalesce(F.try_divide("distinct_ids", "rows_with_id"), F.lit(0.0))
    removal = F.coalesce(
        F.try_divide(F.col("rows_with_id") - F.col("distinct_ids"), F.col("rows_with_id")),
        F.lit(0.0))
    return measured.select(
        F.lit(column).alias("id_column"), "distinct_ids", "rows_with_id",
        F.round(unique, 4).alias("uniqueness"), F.round(removal, 4).alias("removal_share"),
        ((unique >= vocab.MIN_ID_UNIQUENESS) & (removal <= vocab.MAX_ID_REMOVAL))
        .alias("trusted"))


def drop_repeated_ids(df: DataFrame, column: str, keep_first: Sequence[str]) -> DataFrame:
    """First row per id in the given order; rows without an id all stay.

    Rows without an id take no part in the shuffle, and ``rn = 1`` lets Spark keep only the
    first row per id of each partition before shuffling, so a frequent id stays cheap.
    """
    order = Window.partitionBy(column).orderBy(*keep_first)
    first = (df.where(F.col(column).isNotNull()).withColumn("_rn", F.row_number().over(order))
             .where("_rn = 1").drop("_rn"))
    return first.unionByName(df.where(F.col(column).isNull()))


def deduplicate(df: DataFrame, keep_first: Sequence[str] = (), id_name: str | None = None,
                place: str | None = None) -> DataFrame:
    """Gated removal by id, then removal of full-row copies.

    ``keep_first`` orders the rows of one id; the place of a row in its source breaks ties, or,
    without a ``place`` column, all columns do. The copy with the first place stays.
    """
    content = [c for c in df.columns if c != place]
    id_name = id_name or id_column(df.select(*content))
    if id_name is not None and id_gate(df, id_name).first()["trusted"]:
        rest = [place] if place else [c for c in content if c not in keep_first and c != id_name]
        df = drop_repeated_ids(df, id_name, [*keep_first, *rest])
    return drop_full_duplicates(df, place)


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows kept, with a warning below the safe share."""
    counted = after.agg(F.lit(before.count()).cast("long").alias("rows_before"),
                        F.count("*").alias("rows_after"))
    kept = F.coalesce(F.round(F.try_divide(F.col("rows_after") * 100.0, "rows_before"), 1),
                      F.lit(100.0))
    return counted.select(
        "rows_before", "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        kept.alias("retention_pct"), (kept < vocab.RETENTION_WARN_PCT).alias("warning"))
