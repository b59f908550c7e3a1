"""Cleaning files as they arrive: the row-local part of a fitted plan on a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.cleaning import CleaningPlan
from ..session import shared_folder


def landing_rows(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """New CSV files of a folder as text columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def clean_landing(spark: SparkSession, plan: CleaningPlan, folder: str, target: str,
                  name: str) -> StreamingQuery:
    """Append cleaned rows to a parquet table until all files present are done.

    Progress is kept in the shared folder, so a restart continues and repeats no file.
    Duplicate removal and neighbour fills need the whole table and are left to batch runs.
    """
    rows = plan.apply(landing_rows(spark, folder, [p.source for p in plan.columns.values()]))
    return (rows.writeStream.format("parquet").outputMode("append")
            .option("path", target)
            .option("checkpointLocation", f"{shared_folder(spark)}/landing-{name}")
            .trigger(availableNow=True).start())
