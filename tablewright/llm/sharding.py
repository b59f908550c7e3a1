"""Shards of nearly equal bytes by multiway Karmarkar-Karp differencing.

Equal texts stay together, so the units are groups of equal texts. Differencing keeps partial
partitions of k sums, takes the two with the largest spread and adds them in opposite order,
until one is left. Up to `unit_limit` units are differenced in one task. Beyond that, units are
dealt by hash into parts; each part is differenced into `bins` bins of nearly equal bytes, and
the bins are the units of the next level. Groups that are large against a shard (over a
thousandth of it, so at most 1000 per shard) skip the parts and enter the last level, where they
are balanced against bins.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Tables

UNIT_LIMIT, BINS, LARGE = 50_000, 64, 1000
OUTPUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def differencing(sizes: Sequence[int], k: int) -> np.ndarray:
    """The bin of each unit, for k bins of nearly equal sums; ties go by position."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int32)
    heap = [(-int(s), i, (int(s),) + (0,) * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = [x + y for x, y in zip(left, reversed(right))]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        merged = tuple(sums[i] for i in order)
        node = n + len(merges)
        merges.append((a, b, order))
        heapq.heappush(heap, (merged[-1] - merged[0], node, merged))
    places: dict[int, list[int]] = {n + len(merges) - 1: list(range(k))}
    bins = np.zeros(n, np.int32)
    if not merges:
        return bins
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        own = places.pop(node)
        left, right = [0] * k, [0] * k
        for position, bin_ in zip(order, own):
            left[position] = bin_
            right[k - 1 - position] = bin_
        for child, place in ((a, left), (b, right)):
            if child < n:
                bins[child] = place[0]
            else:
                places[child] = place
    return bins


def _difference(units: DataFrame, k: int) -> DataFrame:
    """Columns unit, part, bytes -> unit, part, bin."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("unit", "ascending")])
        bins = differencing(table["bytes"].to_pylist(), k)
        return pa.table({"unit": table["unit"], "part": table["part"], "bytes": table["bytes"], "bin": pa.array(bins)})

    return units.groupBy("part").applyInArrow(run, "unit string, part bigint, bytes bigint, bin int")


def plan_groups(groups: DataFrame, shards: int, tables: Tables, unit_limit: int = UNIT_LIMIT, bins: int = BINS) -> DataFrame:
    """Columns unit, bytes -> unit, shard (one row per unit)."""
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if n <= unit_limit:
        return _difference(groups.select("unit", F.lit(0).cast("bigint").alias("part"), "bytes"), shards).select(
            "unit", F.col("bin").alias("shard"))
    large = F.col("bytes") * (LARGE * shards) > F.lit(total)
    steps, units = [], groups.filter(~large).select("unit", "bytes")
    while n > unit_limit:
        parts = -(-n // unit_limit)
        step = tables.write(_difference(units.select(
            "unit", F.pmod(F.xxhash64("unit"), F.lit(parts)).alias("part"), "bytes"), bins))
        steps.append(step.select("unit", F.concat_ws("/", F.lit(f"bin{len(steps)}"), "part", "bin").alias("parent")))
        units = tables.write(step.groupBy(
            F.concat_ws("/", F.lit(f"bin{len(steps) - 1}"), "part", "bin").alias("unit")).agg(F.sum("bytes").alias("bytes")))
        n = units.count()
    last = units.unionByName(groups.filter(large).select("unit", "bytes"))
    placed = tables.write(_difference(last.select("unit", F.lit(0).cast("bigint").alias("part"), "bytes"), shards)
                          .select("unit", F.col("bin").alias("shard")))
    found = placed
    for i, step in reversed(list(enumerate(steps))):
        # at most `bins` rows per part and thus few against the units; large groups pass down as they are
        below = step.join(found.withColumnRenamed("unit", "parent"), "parent").select("unit", "shard")
        found = below if i else below.unionByName(placed.filter(~F.col("unit").startswith("bin")))
    return found


def shard_documents(docs: DataFrame, shards: int = 8, *, text: str = "text", columns: Sequence[str] | None = None,
                    unit_limit: int = UNIT_LIMIT) -> DataFrame:
    """The given columns (all by default) plus size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1; null texts count as empty and form one group with
    them. Every row keeps its place: repeated rows are members of the same group and get slots of
    their own. Slots count from 0 without gaps in each shard. Columns named like an output are
    replaced. No rows in, no rows out. grown_shard is null: the law is equal bytes.
    """
    tables = Tables(docs.sparkSession, "sharding")
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in OUTPUT]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = tables.write(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("crc"),
        # 64 + 64 + 32 bits and the length tell texts apart
        F.concat_ws(":", F.hex(F.xxhash64(body)), F.hex(F.xxhash64(F.lit(1), body)),
                    F.hex(F.crc32(F.encode(body, "UTF-8"))), F.octet_length(body)).alias("unit")))
    groups = tables.write(rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    plan = tables.write(plan_groups(groups, shards, tables, unit_limit))
    # groups with over a thousandth of the rows, fewer than 1000, are not joined by a shuffle
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = plan.join(groups.filter(F.col("n") * 1000 > total).select("unit"), "unit", "left_semi")
    by_hot = rows.join(F.broadcast(hot), "unit", "left")
    placed = by_hot.filter(F.col("shard").isNotNull()).unionByName(
        by_hot.filter(F.col("shard").isNull()).drop("shard").join(plan, "unit"))
    numbered = tables.write(placed.select(
        "row", "size", "crc", "shard", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    sizes = numbered.groupBy("part", "shard").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part", "shard").orderBy("place")  # a share of one earlier partition
    return (numbered.withColumn("own", F.row_number().over(inside) - 1)
            .join(F.broadcast(offsets), ["part", "shard"])  # a row per partition and shard
            .select("row.*", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                    (F.col("own") + F.col("before")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
