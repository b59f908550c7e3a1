"""Correlations of all pairs of columns from masked cross-products of blocks of columns.

Every partition adds up, for each pair of columns, the number of rows with both present and the
sums, squares and products over these rows, as matrix products of blocks of columns. Only these
partial sums are shuffled: one row per pair and partition, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

BLOCK_COLUMNS = 64
# Below this share of a column's square sum, what is left as its variance may be rounding.
LOST = 1e-8

_SUMS = ("n", "odd", "sx", "sy", "sxx", "syy", "sxy")


def _block_sums(x: tuple, y: tuple) -> np.ndarray:
    """The sums of one batch for all pairs of two blocks, each (values, present, infinite)."""
    (a, here_a, odd_a), (b, here_b, odd_b) = x, y
    return np.stack([here_a.T @ here_b, odd_a.T @ here_b + here_a.T @ odd_b, a.T @ here_b, here_a.T @ b,
                     (a * a).T @ here_b, here_a.T @ (b * b), a.T @ b])


def cross_products(df: DataFrame, columns: Sequence[str], block_columns: int = BLOCK_COLUMNS) -> DataFrame:
    """Per pair of columns (places a < b): rows with both, infinities among them, centred sums.

    Sums are taken about the mean of each column, infinities aside, so that little is lost to rounding.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    plain = [F.when(F.abs(v) < float("inf"), F.col(v)) for v in numbers.columns]
    centres = np.array([m or 0.0 for m in numbers.agg(*[F.avg(v) for v in plain]).first()])
    centres[~np.isfinite(centres)] = 0.0
    cuts = [slice(i, i + block_columns) for i in range(0, len(columns), block_columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            here, odd = ~np.isnan(values), np.isinf(values)
            values = np.where(here & ~odd, values - centres, 0.0)
            blocks = [(values[:, c], here[:, c].astype(float), odd[:, c].astype(float)) for c in cuts]
            for i, x in enumerate(blocks):
                for j in range(i, len(blocks)):
                    sums[i, j] = sums.get((i, j), 0) + _block_sums(x, blocks[j])
        for (i, j), own in sums.items():
            a, b = np.divmod(np.arange(own[0].size), own.shape[2])
            a, b = a + cuts[i].start, b + cuts[j].start
            flat = own.reshape(len(_SUMS), -1)[:, a < b]
            yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b]), *map(pa.array, flat)], ["a", "b", *_SUMS])

    partial = numbers.mapInArrow(run, "a long, b long, " + ", ".join(f"{s} double" for s in _SUMS))
    return partial.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in _SUMS])


def _plain(a: Column, b: Column) -> Column:
    """Correlation of two columns; null, not an error, where one does not vary."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def pair_correlations(df: DataFrame, columns: Sequence[str], block_columns: int = BLOCK_COLUMNS) -> DataFrame:
    """column_a, column_b, r for every pair; r is null or not a number where one side does not vary.

    A pair that is nearly constant against the spread of its columns (its variance may be rounding
    only), or that has an infinity, is settled by Spark's own aggregates in one more pass.
    """
    sums = written(cross_products(df, columns, block_columns))  # one row per pair of columns
    spread = [F.col(f"s{c}{c}") - F.try_divide(F.col(f"s{c}") * F.col(f"s{c}"), F.col("n")) for c in "xy"]
    doubt = (F.col("odd") > 0) | (spread[0] <= LOST * F.col("sxx")) | (spread[1] <= LOST * F.col("syy"))
    together = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    r = F.try_divide(together, F.sqrt(spread[0]) * F.sqrt(spread[1]))
    labels = F.array(*[F.lit(c) for c in columns])
    clear = sums.where((F.col("n") > 1) & ~doubt).select(
        F.get(labels, F.col("a").cast("int")).alias("column_a"), F.get(labels, F.col("b").cast("int")).alias("column_b"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r"))
    unclear = [(row["a"], row["b"]) for row in sums.where((F.col("n") > 1) & doubt).select("a", "b").collect()]
    if not unclear:
        return clear
    one = df.agg(*[_plain(F.col(columns[a]).cast("double"), F.col(columns[b]).cast("double")).alias(f"r{i}")
                   for i, (a, b) in enumerate(unclear)])
    settled = one.select(F.inline(F.array(*[
        F.struct(F.lit(columns[a]).alias("column_a"), F.lit(columns[b]).alias("column_b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(unclear)])))
    return clear.unionByName(settled)
