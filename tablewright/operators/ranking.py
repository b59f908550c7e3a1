"""Exact global order without a window over the whole table in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# Up to this many rows one task sorts comfortably; above it the order is built in parts.
SINGLE_TASK_ROWS = 200_000
BLOCK_ROWS = 500_000


def with_source_place(df: DataFrame, place: str) -> DataFrame:
    """Add the place of each row in its source: file and row for a plain read of numbered files.

    Any other frame is written once with the order in which Spark reads it.
    """
    if df._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"),
                                           F.col("_metadata.row_index").alias("row")).alias(place))
        except AnalysisException:  # files without row numbers
            pass
    return written(df.withColumn(place, F.struct(F.lit("").alias("file"),
                                                 F.monotonically_increasing_id().alias("row"))))


def global_index(df: DataFrame, order: Sequence[str | Column], index: str = "_index",
                 single_task_rows: int = SINGLE_TASK_ROWS, n_rows: int | None = None) -> DataFrame:
    """Add a 0-based row index in the given order, which should be unique per row.

    Large inputs are range-partitioned on the whole order key (so one frequent leading value
    is split as well), sorted inside each partition and written once; a row's index is its
    place in its partition plus the sizes of the partitions before it.
    """
    n_rows = df.count() if n_rows is None else n_rows
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    if n_rows <= single_task_rows:
        return df.withColumn(index, F.row_number().over(Window.orderBy(*keys)) - F.lit(1))
    placed = written(
        _in_parts(df, keys, n_rows)
        .withColumn("_place", F.monotonically_increasing_id())
        .select("*", F.shiftright("_place", 33).cast("int").alias("_part")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition, so this window is small whatever the table
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(index, F.col("_place").bitwiseAND((1 << 33) - 1) + F.col("_offset"))
            .drop("_part", "_place", "_offset"))


def rank_scan(df: DataFrame, order: Sequence[str], at: str, values: Sequence[str],
              single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Places of many columns along one order, from a single sort of the rows.

    For the i-th of ``values`` this adds ``_x{i}``, the 0-based place of the row among the rows
    where it is present, ``_n{i}``, how many these are, and ``_gap{i}``, how far ``at`` (a whole
    number) lies above that of the row present before; place and gap mean nothing where it is null.
    """
    each = range(len(values))
    present = [F.when(F.col(v).isNotNull(), F.col(at)) for v in values]
    if df.count() <= single_task_rows:
        rows = Window.orderBy(*order)
        upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = rows.rowsBetween(Window.unboundedPreceding, -1)
        whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({k: c for i, v in enumerate(values) for k, c in (
            (f"_x{i}", F.count(v).over(upto) - 1), (f"_n{i}", F.count(v).over(whole)),
            (f"_gap{i}", F.col(at) - F.last(present[i], ignorenulls=True).over(before)))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = [0] * len(values), [None] * len(values)
        for batch in batches:
            columns, places = list(batch.columns), batch.column(at).to_numpy()
            for i, v in enumerate(values):
                valid = batch.column(v).is_valid().to_numpy(zero_copy_only=False)
                columns.append(pa.array(np.cumsum(valid) + (seen[i] - 1)))
                own, earlier = places[valid], np.zeros(batch.num_rows, np.int64)
                none = ~valid
                if len(own):
                    earlier[valid] = np.concatenate(([last[i] or 0], own[:-1]))
                    none[np.argmax(valid)] |= last[i] is None
                    seen[i], last[i] = seen[i] + len(own), int(own[-1])
                columns.append(pa.array(earlier, mask=none))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    parted = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id()))
    schema = T.StructType([*parted.schema, *[T.StructField(c, T.LongType()) for i in each
                                             for c in (f"_place{i}", f"_earlier{i}")]])
    placed = written(parted.mapInArrow(run, schema))
    sizes = placed.groupBy("_part").agg(*[
        e for i in each for e in (F.count(values[i]).alias(f"_c{i}"), F.max(present[i]).alias(f"_at{i}"))])
    # one row per partition, so these windows are small whatever the table
    parts = Window.orderBy("_part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = sizes.select("_part", *[
        e for i in each for e in (
            F.coalesce(F.sum(f"_c{i}").over(before), F.lit(0)).alias(f"_offset{i}"),
            F.last(f"_at{i}", ignorenulls=True).over(before).alias(f"_in{i}"),
            F.sum(f"_c{i}").over(whole).alias(f"_n{i}"))])
    return placed.join(carried, "_part").select(*df.columns, *[
        e for i in each for e in (
            (F.col(f"_place{i}") + F.col(f"_offset{i}")).alias(f"_x{i}"), F.col(f"_n{i}"),
            (F.col(at) - F.coalesce(f"_earlier{i}", f"_in{i}")).alias(f"_gap{i}"))])


def _in_parts(df: DataFrame, order: Sequence[str | Column], n_rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Range-partitioned on the whole order and sorted, in parts of bounded numbers of rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionByRange(max(cores, -(-n_rows // block_rows)), *order).sortWithinPartitions(*order)


def carry_fill(df: DataFrame, columns: Sequence[str], order: Sequence[str],
               single_task_rows: int = SINGLE_TASK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fill nulls with the last value before them in order, else with the first one of all.

    Rows are sorted in parts of about ``block_rows`` and filled by one scan of each, and the last value of earlier parts is
    carried in through one row per part.
    """
    n_rows = df.count()
    if n_rows <= single_task_rows:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.first(c, ignorenulls=True).over(whole))
                               for c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [None] * len(columns)
        for batch in batches:
            out = list(batch.columns)
            for i, c in enumerate(columns):
                own = batch.column(c)
                before = carried[i] if carried[i] is not None else pa.nulls(1, own.type)
                every = pa.concat_arrays([before, own])  # the value carried in stands first
                valid = every.is_valid().to_numpy(zero_copy_only=False)
                last = every.take(pa.array(np.maximum.accumulate(np.where(valid, np.arange(len(every)), 0))))
                out.append(last.slice(1))
                carried[i] = last.slice(len(last) - 1)
            yield pa.RecordBatch.from_arrays(out, schema.names)

    parted = (_in_parts(df, order, n_rows, block_rows).withColumn("_part", F.spark_partition_id())
              .withColumn("_place", F.monotonically_increasing_id()))
    schema = T.StructType([*parted.schema, *[T.StructField(f"_carried_{i}", df.schema[c].dataType) for i, c in enumerate(columns)]])
    placed = written(parted.mapInArrow(run, schema))
    at = [F.when(F.col(c).isNotNull(), F.col("_place")) for c in columns]
    edges = placed.groupBy("_part").agg(*[
        e for i, c in enumerate(columns)
        for e in (F.max_by(c, at[i]).alias(f"_last_{i}"), F.min_by(c, at[i]).alias(f"_first_{i}"))])
    # one row per part, so these windows are small whatever the table
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entering = edges.select("_part", *[
        F.coalesce(F.last(f"_last_{i}", ignorenulls=True).over(earlier), F.first(f"_first_{i}", ignorenulls=True).over(whole))
        .alias(f"_in_{i}") for i in range(len(columns))])
    filled = {c: F.coalesce(f"_carried_{i}", f"_in_{i}") for i, c in enumerate(columns)}
    return placed.join(F.broadcast(entering), "_part").withColumns(filled).select(*df.columns)


def sum_before(placed: DataFrame, index: str, weight: str,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_before``: the sum of the weights at smaller indexes, block by block."""
    block = F.floor(F.col(index) / block_rows)
    cut = placed.withColumn("_block", block)
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (cut.groupBy("_block").agg(F.sum(weight).alias("_w"))
               .select("_block", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_carry")))
    within = Window.partitionBy("_block").orderBy(index).rowsBetween(
        Window.unboundedPreceding, -1)
    return (cut.join(carried, "_block")
            .withColumn("_before", F.col("_carry") + F.coalesce(F.sum(weight).over(within),
                                                                F.lit(0))))
