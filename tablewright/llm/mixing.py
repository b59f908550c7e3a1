"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source has a target number of words. Among all document rates that give it, those nearest
to 1 in relative entropy and at most `most` are ``min(most, exp(a * size / mean size))`` with one
multiplier `a` per source: the dual is convex, and Newton steps kept inside a bracket solve it for
all sources at once, each step one grouped aggregate over counts of equal sizes. Rates are then
rounded into whole copies along the sizes of a block of documents, and what a block is still off
(less than about one document) is taken from, or added to, one document as a part of a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_index
from .scratch import Tables

WEIGHTS, MOST, BLOCK_ROWS = (1, 2, 3), 3, 50_000
TOLERANCE, STEPS = 1e-9, 60
OUTPUT = ("size", "source_size", "target", "rate", "copies", "taken")


def n_words(text: Column) -> Column:
    """Runs without white space in a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Columns source, source_size -> plus target: shares of the total by weight, at most `most` times own size.

    Weights repeat over the sources in code point order, null last. What a capped source cannot
    use is dealt to the others by weight until none is above its cap.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    weighted = global_index(sources, [F.col("source").asc_nulls_last()], "_index").withColumn(
        "_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_index") % len(weights) + 1).cast("int")))
    level, capped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("_weight") > F.col("source_size") * most
        n, used, free = weighted.agg(
            F.coalesce(F.sum(above.cast("int")), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("source_size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - used) / free
    return weighted.withColumn("target", F.least(F.lit(float(level)) * F.col("_weight"), (F.col("source_size") * most).cast("double"))
                               ).drop("_index", "_weight")


def _rate(multiplier: Column, size: Column, mean: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(multiplier * size / mean))


def multipliers(sizes: DataFrame, sources: DataFrame, tables: Tables, most: int = MOST) -> DataFrame:
    """Newton steps on the dual; columns source, multiplier.

    sizes: source, size, n. sources: source, source_size, mean, target. A source at its cap keeps
    every document `most` times, one without words or with target 0 none.
    """
    state = tables.write(sources.filter("target > 0 and target < source_size * cast(%d as double)" % most).select(
        "source", "mean", "target", F.log(F.col("target") / F.col("source_size")).alias("a"),
        F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), F.lit(False).alias("done")))
    for _ in range(STEPS):
        at = state.withColumnRenamed("source", "_source")
        rate = _rate(F.col("a"), F.col("size"), F.col("mean"), most)
        sums = sizes.join(at, F.col("source").eqNullSafe(F.col("_source"))).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("value"),
            F.sum(F.when(rate < most, F.col("n") * F.col("size") * rate * F.col("size") / F.col("mean"))).alias("slope"))
        off = F.col("value") - F.col("target")
        low = F.when(off < 0, F.col("a")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("a")).otherwise(F.col("high"))
        step = F.col("a") - off / F.coalesce(F.col("slope"), F.lit(0.0))
        halved = F.when((F.col("low2") > -1e9) & (F.col("high2") < 1e9), (F.col("low2") + F.col("high2")) / 2).when(
            off > 0, F.col("a") * 2 - 1).otherwise(F.col("a") * 2 + 1)
        done = F.abs(off) <= F.col("target") * TOLERANCE
        new = (state.join(sums.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
               .withColumn("low2", low).withColumn("high2", high)
               .select("source", "mean", "target",
                       F.when(done, F.col("a")).when((F.coalesce(F.col("slope"), F.lit(0.0)) > 0) & (step > F.col("low2"))
                                                     & (step < F.col("high2")), step).otherwise(halved).alias("a"),
                       F.col("low2").alias("low"), F.col("high2").alias("high"), done.alias("done")))
        state, old = tables.write(new), state
        tables.remove(old)
        if not state.filter(~F.col("done")).limit(1).count():
            break
    return state.select("source", F.col("a").alias("multiplier"))


def mix_sources(docs: DataFrame, *, source: str = "source", text: str = "text", weights=WEIGHTS, most: int = MOST,
                columns: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The given columns (all by default) plus size, source_size, target, rate, copies, taken.

    `copies` are whole copies (0 to `most`); `taken` are words, copies * size except for about one
    document per block of up to `block_rows` rows, of which a part is taken more or less. A null
    source is a source of its own, null and empty texts have size 0 and are never taken. Repeated
    rows are documents of their own. Reruns on the same rows give the same mix. Columns named
    like an output are replaced. No rows in, no rows out.
    """
    tables = Tables(docs.sparkSession, "mixing")
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in OUTPUT]
    rows = tables.write(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                                    F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")))
    sizes = tables.write(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = tables.write(targets(sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")), weights, most)
        .withColumn("mean", F.col("source_size") / F.col("n_docs")))
    found = multipliers(sizes.filter("size > 0"), sources, tables, most).withColumnRenamed("source", "_s")
    plan = tables.write(sources.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", "mean", "multiplier",
        F.ceil(F.col("n_docs") / block_rows).alias("blocks")))
    rate = F.when(F.col("multiplier").isNotNull(), _rate(F.col("multiplier"), F.col("size"), F.col("mean"), most)).otherwise(
        F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0))
    rated = (rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
             .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
             .withColumn("mark", F.xxhash64("row", "size"))
             .withColumn("block", F.pmod(F.col("mark"), F.col("blocks"))))
    block = Window.partitionBy("source", "block")
    along = block.orderBy("size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    largest = block.orderBy(F.desc("size"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, -1)
    copied = (rated.withColumn("cum", F.sum("rate").over(along))
              .withColumn("prev", F.coalesce(F.lag("cum").over(block.orderBy("size", "mark")), F.lit(0.0)))
              .withColumn("copies", F.when(F.col("size") > 0, F.least(
                  F.lit(most), F.floor(F.col("cum") + 0.5) - F.floor(F.col("prev") + 0.5))).otherwise(0).cast("int"))
              .withColumn("off", F.round(F.sum(F.col("rate") * F.col("size")).over(block)).cast("bigint")
                          - F.sum(F.col("copies") * F.col("size")).over(block)))
    room = F.when(F.col("off") > 0, (F.lit(most) - F.col("copies")) * F.col("size")).otherwise(F.col("copies") * F.col("size"))
    moved = F.greatest(F.lit(0), F.least(F.abs("off") - F.coalesce(F.sum("room").over(largest), F.lit(0)), F.col("room")))
    return (copied.withColumn("room", room).withColumn("moved", moved)
            .select("row.*", "size", "source_size", "target", "rate", "copies",
                    (F.col("copies") * F.col("size") + F.signum("off").cast("bigint") * F.col("moved")).cast("bigint").alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it has copies, columns unchanged."""
    names = docs.columns
    mixed = mix_sources(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
                                    F.col(options.pop("source", "source")).alias("_source"),
                                    F.col(options.pop("text", "text")).alias("_text")),
                        source="_source", text="_text", columns=["_row"], **options)
    return (mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
            .select(*[F.col(f"_row.`{c}`").alias(c) for c in names]))
