"""Exact k nearest binary codes by incremental multi-index hashing.

A code of `bits` bits is cut into segments of 16. Two codes at Hamming distance up to
``segments * (r + 1) - 1`` agree in some segment up to `r` bits, so once all segments were searched
up to radius `r`, every code within that distance has been met and verified. A query's radius
grows until `k` verified neighbours lie within the covered distance; codes further away than the
k-th so far are dropped where they are met. Equal codes are one entry of
the index, which keeps the k + 1 smallest ids of each: no other id can be among the k nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Tables

SEGMENT = 16
BITS = 64


def sign_code(vector: str, bits: int = BITS) -> Column:
    """One bit per dimension, set where the value is above 0; absent and null values give 0."""
    return F.expr(f"aggregate(sequence(0, {bits - 1}), 0L, (a, i) -> a | shiftleft(if(coalesce(get(`{vector}`, i), 0) > 0, 1L, 0L), i))")


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS) -> DataFrame:
    """Columns id, code of both sides -> query_id, rank, neighbor_id, distance.

    A row is not its own neighbour, and equal distances go by the smaller id. Rows with a null id
    or code are neither found nor searched for. Repeated rows (same id and code) count once. With
    fewer than k other rows, all of them are returned. Other columns are not looked at.
    """
    tables = Tables(codes.sparkSession, "hamming")
    segments = bits // SEGMENT
    by_code = Window.partitionBy("code").orderBy("id")
    # only the k + 1 smallest ids of a code leave a partition
    members = tables.write(codes.select("id", "code").filter("id is not null and code is not null").distinct()
                           .withColumn("place", F.row_number().over(by_code)).filter(F.col("place") <= k + 1))
    entries = members.groupBy("code").agg(F.count("*").alias("ids"))
    piece = [F.shiftrightunsigned("code", SEGMENT * s).bitwiseAND((1 << SEGMENT) - 1) for s in range(segments)]
    pieces = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), p.cast("int").alias("value")) for s, p in enumerate(piece)]))
    index = tables.write(entries.select("code", "ids", pieces.alias("p")).select("code", "ids", "p.segment", "p.value"))
    asked = tables.write(queries.select(F.col("id").alias("query_id"), "code").filter("query_id is not null and code is not null").distinct())
    # bound: a code further away than this is not among the k nearest
    open_codes = asked.select("code").distinct().withColumn("bound", F.lit(bits))
    # the values at each radius from 0: at most 12,870 per radius, 65,536 in all
    masks = tables.write(codes.sparkSession.range(1 << SEGMENT).select(F.col("id").cast("int").alias("mask"), F.bit_count("id").alias("radius"))
                         .groupBy("radius").agg(F.collect_list("mask").alias("masks")))
    n_entries = entries.count()
    nearer = Window.partitionBy("query").orderBy("distance")
    found, met, settled = None, None, []
    for radius in range(SEGMENT + 1):
        probes = (open_codes.select(F.col("code").alias("query"), "bound", F.lit(radius).alias("radius"), pieces.alias("p"))
                  .join(F.broadcast(masks), "radius")
                  .select("query", "bound", F.col("p.segment").alias("segment"), F.col("p.value").alias("own"), F.explode("masks").alias("mask"))
                  .select("query", "bound", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value")))
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        other = index.select("code", "ids", F.col("segment").alias("_segment"), F.col("value").alias("_value"))
        now = probes.join(other, (F.col("segment") == F.col("_segment")) & (F.col("value") == F.col("_value")) & (distance <= F.col("bound"))).select(
            "query", "code", "ids", distance.alias("distance"))
        earlier = met
        every = (now if earlier is None else now.unionByName(earlier)).distinct()
        met = tables.write(every.withColumn("within", F.sum("ids").over(nearer)).withColumn(
            "bound", F.coalesce(F.min(F.when(F.col("within") > k, F.col("distance"))).over(Window.partitionBy("query")), F.lit(bits)))
            .filter("distance <= bound").select("query", "code", "ids", "distance", "bound"))
        if earlier is not None:
            tables.remove(earlier)
        covered = segments * (radius + 1) - 1
        # the k-th verified distance is covered, or there is nothing else
        state = tables.write(met.groupBy("query").agg(F.min("bound").alias("bound"), F.count("*").alias("all")).withColumn(
            "done", (F.col("bound") <= covered) | (F.col("all") == n_entries) | F.lit(radius == SEGMENT)))
        settled.append(tables.write(met.join(state.filter("done"), "query", "left_semi").drop("bound")))
        met = tables.write(met.join(state.filter("done"), "query", "left_anti").drop("bound"))
        still = state.select(F.col("query").alias("code"), F.col("bound").alias("now"), "done")
        open_codes = tables.write(open_codes.join(still, "code", "left").filter(~F.coalesce("done", F.lit(False))).select(
            "code", F.coalesce("now", "bound").alias("bound")))
        if not open_codes.limit(1).count():
            break
    for part in settled:
        found = part if found is None else found.unionByName(part)
    by_query = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    # of each query's codes only those that can hold one of its k + 1 nearest ids go on
    near = found.withColumn("rank", F.rank().over(Window.partitionBy("query").orderBy("distance"))).filter(F.col("rank") <= k + 1)
    pairs = asked.withColumnRenamed("code", "query").join(near, "query").join(members.select("code", F.col("id").alias("neighbor_id")), "code")
    return (pairs.filter("query_id <> neighbor_id").withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "neighbor_id", F.col("distance").cast("int").alias("distance")))
