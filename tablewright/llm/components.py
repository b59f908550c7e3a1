"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """Columns a, b (longs) -> node, root: the smallest node each one is connected with.

    Every node links its larger neighbours to its smallest one, then its smaller neighbours;
    the edges end as stars after a number of rounds that grows with the logarithm of the nodes. A node's
    neighbours are never collected, only their minimum.
    """
    now = tables.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sums = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        smaller = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smaller, "a").select(F.col("b").alias("x"), "a", "m")
        new = tables.write(small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(
            smaller.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        tables.remove(now)
        now = new
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == sums:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        sums = state
