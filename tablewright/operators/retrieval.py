"""Overlapping text chunks and exact similarity search over stored vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import trimmed

CHUNK_SIZE = 500
# Numbers of a block of queries and of a part of the corpus, and scores held at once.
QUERY_NUMBERS = 4_000_000


def chunk_array(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Chunks of a text with 10% overlap, blank ones dropped."""
    step = size - size // 10
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    chunks = F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))
    return F.filter(chunks, lambda c: trimmed(c) != "")


def chunk_rows(df: DataFrame, text: str, keep: Sequence[str], size: int = CHUNK_SIZE) -> DataFrame:
    """One row per chunk with its index among the non-blank ones and their number, no shuffle."""
    chunks = df.select(*keep, chunk_array(F.col(text), size).alias("_chunks"))
    return chunks.select(*keep, F.size("_chunks").alias("total_chunks"),
                         F.posexplode("_chunks").alias("chunk_index", "text"))


def chunk_records(df: DataFrame, text: str, username: str, dataset: str, timestamp: str,
                  size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks as stored: id user__dataset__timestamp__chunkN and the fields to filter on."""
    rows = chunk_rows(df, text, [username, dataset, timestamp], size)
    identity = F.concat_ws("__", username, dataset, timestamp,
                           F.concat(F.lit("chunk"), F.col("chunk_index").cast("string")))
    return rows.select(identity.alias("id"), "text", F.col(username).alias("username"),
                       F.col(dataset).alias("dataset_name"), F.col(timestamp).alias("timestamp"),
                       "chunk_index", "total_chunks")


def similar(corpus: DataFrame, queries: DataFrame, k: int = 5, item: str = "vec_id",
            vector: str = "embedding", query: str = "query_id", owner: str | None = None,
            query_numbers: int = QUERY_NUMBERS) -> DataFrame:
    """The k most similar corpus rows per query, exactly, by cosine.

    Queries are cut into blocks and the corpus into parts, both of at most ``query_numbers`` numbers;
    every part meets every block in a task of its own, which keeps its best k per query. What is
    shuffled after that is bounded by parts x queries x k, and nothing goes through the driver.
    With ``owner`` a query meets only rows of its own owner.
    """
    n, width = queries.agg(F.count("*"), F.max(F.size(vector))).first()
    schema = T.StructType([
        T.StructField(query, queries.schema[query].dataType),
        T.StructField(item, corpus.schema[item].dataType),
        T.StructField("cosine", T.DoubleType())])
    if not n:
        return queries.sparkSession.createDataFrame([], schema).selectExpr(
            "*", "0 AS rank", "0D AS score").drop("cosine")
    own = [owner] if owner else []
    blocks = max(1, -(-n * width // query_numbers))
    parts = max(1, -(-corpus.count() * width // query_numbers))
    number = (lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    left = corpus.select(item, vector, *own).where(F.col(vector).isNotNull()).withColumn(
        "_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).withColumn("_block", number(blocks))
    right = queries.select(query, vector, *own).withColumn(
        "_block", F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int")).withColumn("_part", number(parts))

    def best(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return _best_of_part(rows, wanted, k, item, vector, query, owner)

    found = left.groupBy("_block", "_part").cogroup(right.groupBy("_block", "_part")).applyInPandas(best, schema)
    place = F.row_number().over(
        Window.partitionBy(query).orderBy(F.desc("cosine"), F.asc(item)))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select(query, item, "rank", F.round("cosine", 3).alias("score")))


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best_of_part(rows: pd.DataFrame, wanted: pd.DataFrame, k: int, item: str, vector: str, query: str,
                  owner: str | None) -> pd.DataFrame:
    """The best k rows of one part for each query of one block, ties to the smaller item."""
    out: list[tuple] = []
    if len(rows) and len(wanted):
        rows = rows.sort_values(item, kind="stable")
        units, ids = _unit(rows[vector]), rows[item].to_numpy()
        targets, labels = _unit(wanted[vector]), wanted[query].to_numpy()
        owners = (rows[owner].to_numpy(), wanted[owner].to_numpy()) if owner else None
        at_once = max(1, QUERY_NUMBERS // len(rows))
        for begin in range(0, len(labels), at_once):
            scores = targets[begin: begin + at_once] @ units.T
            for i, own in enumerate(scores, begin):
                among = np.arange(len(ids)) if owners is None else np.flatnonzero(owners[0] == owners[1][i])
                mine = own[among]
                if len(among) > k:  # everything as good as the k-th best, ties included
                    good = mine >= np.partition(mine, -k)[-k]
                    among, mine = among[good], mine[good]
                first = np.argsort(-mine, kind="stable")[:k]
                out += [(labels[i], ids[among[j]], float(mine[j])) for j in first]
    return pd.DataFrame(out, columns=[query, item, "cosine"])
