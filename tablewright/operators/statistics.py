"""Verified statistics: KPIs, correlations, anomalies, categories, revenue, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, vocab
from ..functions.cells import without_nan
from .dedup import duplicate_rows
from .cross_products import pair_correlations
from .profile import (identifier_columns, long_rows, percentile_columns, top_values,
                      value_counts)


def kpis(df: DataFrame, max_kpis: int | None = vocab.MAX_KPIS, exclude: Sequence[str] = ()) \
        -> DataFrame:
    """Key figures of the numeric columns that vary and are not keys, widest spread first."""
    df = without_nan(df)
    candidates = names.numeric_columns(df, exclude)
    keys = set(identifier_columns(df, candidates))
    columns = [c for c in candidates if c not in keys]
    if not columns:
        figures = ", ".join(f"{m} double" for m in ("mean", "median", "std", "min", "max", "sum"))
        return df.sparkSession.createDataFrame(
            [], f"column string, {figures}, count bigint, coefficient_of_variation double")
    median = percentile_columns(df, columns, [0.5], df.count())
    one = df.agg(*[
        F.struct(F.avg(c).alias("mean"), median[c][0].alias("median"),
                 F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                 F.max(c).cast("double").alias("max"), F.sum(F.col(c).cast("double")).alias("sum"),
                 F.count(c).alias("count")).alias(f"s{i}") for i, c in enumerate(columns)])
    rows = long_rows(one, [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s"))
                           for i, c in enumerate(columns)])
    ranked = (rows.where("s.min < s.max").orderBy(F.desc("s.std"), "column"))
    if max_kpis is not None:
        ranked = ranked.limit(max_kpis)
    return ranked.select(
        "column", *[F.round(f"s.{m}", 2).alias(m)
                    for m in ("mean", "median", "std", "min", "max", "sum")],
        F.col("s.count").alias("count"),
        F.round(F.try_divide("s.std", "s.mean"), 3).alias("coefficient_of_variation"))


def correlations(df: DataFrame, threshold: float = vocab.STRONG_CORRELATION,
                 exclude: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every numeric pair over rows where both are present."""
    df = without_nan(df)
    columns = names.numeric_columns(df, exclude)
    schema = "column_a string, column_b string, correlation double, direction string"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    found = pair_correlations(df, columns)
    return (found.where(~F.isnan("r") & (F.abs("r") >= threshold))
            .select("column_a", "column_b", F.round("r", 3).alias("correlation"),
                    F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"))
            .orderBy(F.desc(F.abs("correlation")), "column_a", "column_b"))


def adjusted_skewness(c: str) -> Column:
    """Sample skewness with the usual bias correction; null below three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2))


def _spread(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    """Count, mean and deviation of columns with at least 10 values that vary."""
    if not columns:
        return {}
    row = df.agg(*[F.struct(F.count(c), F.avg(c), F.stddev_samp(c)).alias(f"c{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: tuple(row[f"c{i}"]) for i, c in enumerate(columns)
            if row[f"c{i}"][0] >= 10 and row[f"c{i}"][2]}


def _is_far(c: str, mean: float, std: float, z: float) -> Column:
    return F.abs((F.col(c) - F.lit(mean)) / F.lit(std)) > z


def anomalies(df: DataFrame, z_threshold: float = 3.0, exclude: Sequence[str] = ()) -> DataFrame:
    """Outlier counts and skew of the numeric columns that show any."""
    df = without_nan(df)
    columns = names.numeric_columns(df, exclude)
    quartiles = percentile_columns(df, columns, [0.25, 0.75], df.count())
    row = df.agg(*[
        F.struct(F.count(c), F.avg(c), F.stddev_samp(c), adjusted_skewness(c), *quartiles[c])
        .alias(f"c{i}") for i, c in enumerate(columns)]).first() if columns else {}
    checks = []
    for i, c in enumerate(columns):
        n, mean, std, skew, q1, q3 = row[f"c{i}"]
        if n < 10 or not std:
            continue
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        outside = (F.count_if((F.col(c) < low) | (F.col(c) > high)) if q3 > q1
                   else F.lit(0).cast("long"))
        checks.append((c, skew, F.count_if(_is_far(c, mean, std, z_threshold)), outside))
    schema = ("column string, z_score_outliers bigint, iqr_outliers bigint, skew double, "
              "skew_direction string")
    if not checks:
        return df.sparkSession.createDataFrame([], schema)
    one = df.agg(*[F.struct(far.alias("z"), outside.alias("iqr")).alias(f"c{i}")
                   for i, (_, _, far, outside) in enumerate(checks)])
    rows = long_rows(one, [
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}.z").alias("z_score_outliers"),
                 F.col(f"c{i}.iqr").alias("iqr_outliers"), F.lit(float(skew)).alias("raw_skew"))
        for i, (c, skew, _, _) in enumerate(checks)])
    direction = (F.when(F.col("raw_skew") > 1.5, "right (high-value outliers)")
                 .when(F.col("raw_skew") < -1.5, "left (low-value outliers)").otherwise("normal"))
    return (rows.where("z_score_outliers > 0 OR iqr_outliers > 0 OR abs(raw_skew) > 1.5")
            .select("column", "z_score_outliers", "iqr_outliers",
                    F.round("raw_skew", 2).alias("skew"), direction.alias("skew_direction")))


def category_summary(df: DataFrame, top_n: int = 5, columns: Sequence[str] | None = None) \
        -> DataFrame:
    """Most frequent values of each text column; shares are of all rows, nulls included."""
    columns = list(columns or names.text_columns(df))
    counts = value_counts(df, columns)
    distinct = counts.groupBy("column").agg(F.count("*").alias("unique_values"))
    share = F.round(F.col("count") * 100.0 / F.lit(df.count()), 1)
    return (top_values(counts, top_n).join(F.broadcast(distinct), "column")  # one row per column
            .select("column", "unique_values", F.col("rank").cast("int").alias("rank"), "value",
                    "count", share.alias("pct")))


def chart_columns(df: DataFrame) -> DataFrame:
    """Which text columns are readable on a chart: few values, none of them negligible."""
    top = category_summary(df, top_n=1)
    fits = ((F.col("unique_values") <= vocab.CHART_MAX_DISTINCT)
            & (F.col("pct") >= vocab.CHART_MIN_TOP_PCT))
    return top.select("column", "unique_values", F.col("pct").alias("top_pct"),
                      fits.alias("eligible"))


def keyword_completed(status: Column) -> Column:
    """Completed unless the status mentions cancelling, failing, refunding and the like."""
    return ~F.lower(status).rlike("|".join(vocab.NON_COMPLETED_FRAGMENTS))


def revenue_by_status(df: DataFrame, status: str | None = None, money: str | None = None,
                      classification: DataFrame | None = None) -> DataFrame | None:
    """Revenue, rows and share per status, with the total, the reliable and the excluded part.

    ``classification`` holds (status, is_completed); statuses it lacks count as completed.
    Without it the status wording decides. None if the table has no status or money column.
    """
    status = status or names.status_column(df)
    money = money or names.money_column(df)
    if status is None or money is None:
        return None
    grouped = (without_nan(df).select(F.col(status).cast("string").alias("status"),
                                      F.col(money).cast("double").alias("_money"))
               .na.drop().groupBy("status")
               .agg(F.sum("_money").alias("_revenue"), F.count("*").alias("count")))
    if classification is not None:
        grouped = (grouped.join(classification.select("status", "is_completed"), "status", "left")
                   .withColumn("is_completed", F.coalesce("is_completed", F.lit(True))))
    else:
        grouped = grouped.withColumn("is_completed", keyword_completed(F.col("status")))
    totals = grouped.agg(F.struct(
        F.sum("_revenue").alias("total"),
        F.coalesce(F.sum(F.when(F.col("is_completed"), F.col("_revenue"))), F.lit(0.0))
        .alias("reliable")))
    shown = grouped.withColumn("_all", totals.scalar())
    return shown.select(
        "status", F.round("_revenue", 2).alias("revenue"), "count",
        F.coalesce(F.round(F.try_divide(F.col("_revenue") * 100, F.col("_all.total")), 1),
                   F.lit(0.0)).alias("pct_of_total_revenue"),
        "is_completed",
        F.round("_all.total", 2).alias("total_revenue"),
        F.round("_all.reliable", 2).alias("reliable_revenue"),
        F.round(F.col("_all.total") - F.col("_all.reliable"), 2).alias("excluded_revenue"),
    ).orderBy(F.desc("revenue"), "status")


def classify_statuses(df: DataFrame, lookup: DataFrame, status: str | None = None) -> DataFrame:
    """Distinct statuses of the table with the supplied classification, completed by default."""
    status = status or names.status_column(df)
    present = df.select(F.col(status).alias("status")).na.drop().distinct()
    return (present.join(lookup.select("status", "is_completed"), "status", "left")
            .withColumn("is_completed", F.coalesce("is_completed", F.lit(True))))


def quality_score(df: DataFrame) -> DataFrame:
    """Completeness, uniqueness and validity, weighted into one graded score."""
    df = without_nan(df)
    spread = _spread(df, names.numeric_columns(df))
    n_duplicates = duplicate_rows(df).first()["duplicate_rows"]
    rates = [F.avg(F.when(F.col(c).isNotNull(), _is_far(c, mean, std, 3.0).cast("double")))
             for c, (_, mean, std) in spread.items()]
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    one = df.agg(F.count("*").alias("n"), missing.cast("long").alias("missing_cells"),
                 (1 - sum(rates, F.lit(0.0)) / len(rates) if rates else F.lit(1.0))
                 .alias("validity"))
    whole = F.lit(1.0)
    parts = one.select(
        "missing_cells", "validity",
        F.coalesce(1 - F.try_divide("missing_cells", F.col("n") * float(len(df.columns))), whole)
        .alias("completeness"),
        F.coalesce(1 - F.try_divide(F.lit(n_duplicates).cast("double"), F.col("n")), whole)
        .alias("uniqueness"))
    overall = F.round((F.col("completeness") * 0.4 + F.col("uniqueness") * 0.3
                       + F.col("validity") * 0.3) * 100, 1)
    scored = parts.withColumn("overall_score", overall)
    score = F.col("overall_score")
    grade = (F.when(score >= 95, "A+").when(score >= 90, "A").when(score >= 85, "B+")
             .when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F"))
    return scored.select(
        "overall_score", grade.alias("grade"),
        F.round(F.col("completeness") * 100, 1).alias("completeness_pct"),
        F.round(F.col("uniqueness") * 100, 1).alias("uniqueness_pct"),
        F.round(F.col("validity") * 100, 1).alias("validity_pct"),
        "missing_cells", F.lit(n_duplicates).cast("long").alias("duplicate_rows"))
