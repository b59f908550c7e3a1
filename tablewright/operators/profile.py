"""Column profiles: missing cells, numeric summaries, roles and value frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, vocab
from ..functions.cells import is_null_marker, is_title_case, without_nan
from ..functions.counts import value_counts
from .dedup import duplicate_rows
from .quantiles import BUILT_IN_ROWS, exact_quantiles


def long_rows(one_row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct (there is one per column)."""
    return one_row.select(F.inline(F.array(*structs)))


def percentile_columns(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                       n_rows: int) -> dict[str, list[Column]]:
    """Exact percentiles as columns for one aggregate: built in, or found beforehand."""
    if n_rows <= BUILT_IN_ROWS:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        return {c: [F.percentile(c, probs)[i] for i in range(len(probabilities))]
                for c in columns}
    found = exact_quantiles(df, columns, probabilities, n_rows=n_rows)
    return {c: [F.lit(v).cast("double") for v in found[c]] for c in columns}


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing cells per column, their share of rows and of all missing cells."""
    df = without_nan(df)
    one = df.agg(F.count("*").alias("n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    total = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0).cast("long"))
    return long_rows(one, [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"),
                 F.round(F.try_divide(F.col(f"m{i}") * 100.0, F.col("n")), 1).alias("missing_pct"),
                 total.alias("total_missing"))
        for i, c in enumerate(df.columns)])


def raw_missing(df: DataFrame) -> DataFrame:
    """Missing cells of an unclean table, counting the usual null spellings as missing too."""
    literal = [F.count_if(F.col(c).isin(*vocab.RAW_MISSING_LITERALS))
               for c in names.text_columns(df)]
    null = [F.count_if(F.col(c).isNull()) for c in df.columns]
    return df.agg(F.count("*").alias("n_rows"),
                  sum(null, F.lit(0)).cast("long").alias("null_cells"),
                  sum(literal, F.lit(0)).cast("long").alias("null_text_cells"),
                  sum(null + literal, F.lit(0)).cast("long").alias("missing_cells"))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, sample deviation, minimum, median and maximum of each numeric column."""
    df = without_nan(df)
    columns = list(columns or names.numeric_columns(df))
    median = percentile_columns(df, columns, [0.5], df.count())
    one = df.agg(*[
        F.struct(F.round(F.avg(c), 2).alias("mean"), F.round(F.stddev_samp(c), 2).alias("std"),
                 F.round(F.min(c).cast("double"), 2).alias("min"),
                 F.round(median[c][0], 2).alias("median"),
                 F.round(F.max(c).cast("double"), 2).alias("max")).alias(f"s{i}")
        for i, c in enumerate(columns)])
    return long_rows(one, [
        F.struct(F.lit(c).alias("column"), *[F.col(f"s{i}.{m}").alias(m)
                                             for m in ("mean", "std", "min", "median", "max")])
        for i, c in enumerate(columns)])


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per column, equal counts by value."""
    rank = F.row_number().over(
        Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value")))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def column_profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """Type, distinct values, missing share and the smallest sample values of each column."""
    df = without_nan(df)
    counts = value_counts(df, df.columns)
    first = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    sampled = (counts.select("column", "value").withColumn("_rank", first)
               .where(F.col("_rank") <= samples).groupBy("column")
               .agg(F.array_sort(F.collect_list("value")).alias("sample_values")))
    distinct = counts.groupBy("column").agg(F.count("*").alias("n_unique"))
    types = dict(df.dtypes)
    shape = missing_profile(df).select("column", "missing_pct")
    dtype = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])[F.col("column")]
    # one row per column on every side, so the sides are as small as the schema
    return (shape.join(F.broadcast(distinct), "column", "left")
            .join(F.broadcast(sampled), "column", "left")
            .select("column", dtype.alias("dtype"),
                    F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"), "missing_pct",
                    F.concat_ws("|", "sample_values").alias("sample_values")))


def column_roles(df: DataFrame) -> DataFrame:
    """Role of each column: id, datetime, numeric, categorical (few distinct values) or text."""
    by_name = {c: "id" for c in df.columns if names.is_identifier_role(c)}
    fixed = ({c: "numeric" for c in names.numeric_columns(df)}
             | {c: "datetime" for c in names.date_columns(df)} | by_name)
    text = names.text_columns(df, exclude=fixed)
    spark = df.sparkSession
    known = spark.createDataFrame(
        [(c, fixed.get(c), i) for i, c in enumerate(df.columns)],
        "column string, fixed_role string, position int")
    if not text:
        return known.select("column", F.coalesce("fixed_role", F.lit("text")).alias("role"))
    distinct = value_counts(df, text).groupBy("column").agg(F.count("*").alias("n"))
    few = F.coalesce("n", F.lit(0)) <= vocab.CATEGORY_MAX_DISTINCT
    return (known.join(F.broadcast(distinct), "column", "left")
            .select("column", F.coalesce("fixed_role", F.when(few, "categorical")
                                         .otherwise("text")).alias("role")))


def domain_evidence(df: DataFrame) -> DataFrame:
    """Shape of the table and the range and mean of its numeric columns."""
    df = without_nan(df)
    columns = names.numeric_columns(df)
    one = df.agg(F.count("*").alias("row_count"), *[
        F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
                 F.round(F.avg(c), 2).alias("mean")).alias(f"s{i}")
        for i, c in enumerate(columns)])
    return long_rows(one, [
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}.min").alias("min"),
                 F.col(f"s{i}.max").alias("max"), F.col(f"s{i}.mean").alias("mean"),
                 F.col("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"))
        for i, c in enumerate(columns)])


def identifier_columns(df: DataFrame, columns: Sequence[str],
                       fragments: Sequence[str] = vocab.IDENTIFIER_FRAGMENTS) -> list[str]:
    """Numeric columns that are keys: named like one, whole numbers, no value twice.

    More rows than whole numbers between minimum and maximum proves a repeat, which settles
    most foreign keys without looking for duplicates.
    """
    named = [c for c in columns if names.has_fragment(c, fragments)]
    if not named:
        return []
    row = df.agg(*[
        F.struct(F.count(c), F.min(c), F.max(c), F.bool_and(F.col(c) % 1 == 0)).alias(f"c{i}")
        for i, c in enumerate(named)]).first()
    keys = []
    for i, c in enumerate(named):
        n, low, high, whole = row[f"c{i}"]
        if not n or not whole or high - low + 1 < n:
            continue
        repeated = (df.where(F.col(c).isNotNull()).groupBy(c).count()
                    .where("count > 1").limit(1).count())
        if not repeated:
            keys.append(c)
    return keys


def scorecard_side(df: DataFrame, side: str) -> DataFrame:
    """Completeness, uniqueness, validity, consistency and grade of one table.

    Text is judged on its distinct values with their counts, so patterns run once per value.
    """
    df = without_nan(df)
    text = names.text_columns(df)
    other = [c for c in df.columns if c not in text]
    marker, formed = is_null_marker(F.col("value")), is_title_case(F.col("value"))
    judged = value_counts(df, text).groupBy("column").agg(
        F.count("*").alias("distinct"), F.sum("count").alias("cells"),
        F.coalesce(F.sum(F.when(marker, F.col("count"))), F.lit(0)).alias("invalid"),
        F.coalesce(F.sum(F.when(formed, F.col("count"))), F.lit(0)).alias("formed")
    ).collect() if text else []  # one row per column
    row = df.agg(F.count("*"), sum((F.count(c) for c in other), F.lit(0)).cast("long")).first()
    n_rows, present = row[0], row[1] + sum(r["cells"] for r in judged)
    n_duplicates = duplicate_rows(df).first()["duplicate_rows"]
    categories = [r for r in judged if r["distinct"] <= vocab.CATEGORY_MAX_DISTINCT]
    consistent = sum(r["formed"] / r["cells"] >= 0.9 for r in categories)
    n_categories, n_empty = len(categories), len(text) - len(judged)  # an empty column is in order
    n_cells, n_text = n_rows * len(df.columns), sum(r["cells"] for r in judged)

    def pct(part: int, whole: int) -> Column:
        return F.round(F.lit(100.0 - part * 100.0 / whole if whole else 100.0), 1)

    one = df.sparkSession.range(1).select(
        pct(n_cells - present, n_cells).alias("completeness_pct"),
        pct(n_duplicates, n_rows).alias("uniqueness_pct"),
        pct(sum(r["invalid"] for r in judged), n_text).alias("validity_pct"),
        pct(n_categories - consistent, n_categories + n_empty).alias("consistency_pct"))
    score = (F.col("completeness_pct") + F.col("uniqueness_pct") + F.col("validity_pct")
             + F.col("consistency_pct")) / 4
    grade = (F.when(score >= 95, "A").when(score >= 85, "B").when(score >= 70, "C")
             .when(score >= 50, "D").otherwise("F"))
    return one.select(F.lit(side).alias("side"), "*", grade.alias("grade"),
                      F.round(score, 2).alias("score"))


def scorecard(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Both sides, with the gain in points of the cleaned one."""
    before, after = scorecard_side(raw, "before"), scorecard_side(cleaned, "after")
    gain = F.max_by("score", F.when(F.col("side") == "after", 1)) \
        - F.max_by("score", F.when(F.col("side") == "before", 1))
    both = before.unionByName(after)
    return both.withColumn("delta_points", both.agg(F.round(gain, 1)).scalar())
