"""Intermediate tables in the folder shared by the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

#: Spark then removes the shuffle files of a query as soon as the query has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Row groups of few MB, looked at after every row: a task that writes or reads rows of up to a MB holds few of them.
SMALL_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"}


class Tables:
    """Writes tables that later steps read again; survives the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str, options: dict[str, str] | None = None):
        self.spark = spark
        self.options = options or {}
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        self.count += 1
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", codec).options(**self.options).parquet(path, partitionBy=partition_by)
        finally:
            self.spark.conf.set(_CLEAN, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._path = path
        return table

    def remove(self, table: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(table._path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(names: list[str], wanted: str) -> str:
    """A column name that is not taken, whatever its case."""
    taken = {n.lower() for n in names}
    return next(w for w in (wanted + "_" * i for i in range(len(taken) + 1)) if w.lower() not in taken)
