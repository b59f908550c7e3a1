"""Report chunks in a parquet table laid out by user and dataset.

The layout makes listing, filtering and deleting one user's dataset a matter of directories.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.retrieval import CHUNK_SIZE, chunk_records, similar

SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("chunk_index", T.IntegerType()),
    T.StructField("total_chunks", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("username", T.StringType()), T.StructField("dataset_name", T.StringType())])


class ReportStore:
    """Append, search, list and delete; vectors come from a caller-supplied column function."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def add(self, reports: DataFrame, embed, chunk_size: int = CHUNK_SIZE) -> int:
        """Chunk, embed and append reports (text, username, dataset_name, timestamp)."""
        records = chunk_records(reports, "text", "username", "dataset_name", "timestamp",
                                chunk_size)
        n = records.count()
        rows = records.withColumn("embedding", embed(F.col("text")).cast("array<float>"))
        (rows.select(*SCHEMA.names).write.mode("append")
         .partitionBy("username", "dataset_name").parquet(self.path))
        return n

    def of(self, username: str, dataset: str | None = None) -> DataFrame:
        """One owner's chunks; both filters prune directories."""
        mine = self.table().where(F.col("username") == username)
        return mine if dataset is None else mine.where(F.col("dataset_name") == dataset)

    def query(self, queries: DataFrame, username: str, dataset: str | None = None,
              k: int = 5) -> DataFrame:
        """Best chunks per query (query_id, embedding) among the owner's own."""
        mine = self.of(username, dataset)
        hits = similar(mine, queries, k, item="id")
        fields = mine.select("id", "text", "dataset_name", "timestamp")
        return fields.join(F.broadcast(hits), "id").select(  # k rows per query
            "query_id", "rank", "text", "dataset_name", "timestamp", "score")

    def datasets(self, username: str) -> DataFrame:
        return self.of(username).select("dataset_name").distinct().orderBy("dataset_name")

    def delete(self, username: str, dataset: str) -> int:
        """Remove one owner's dataset with its partition; returns chunks removed."""
        mine = self.of(username, dataset)
        n = mine.count()
        # file names come URL-encoded; the folder of a partition is one, whatever the names hold
        folders = {unquote(r[0]).rsplit("/", 1)[0] for r in mine.select(F.input_file_name()).distinct().collect()}
        for folder in folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return n
