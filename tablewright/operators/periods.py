"""Calendar totals, volume spikes, and year and month comparisons with sample guards.

One aggregation over the data gives a row per calendar month; everything else works on those
rows, whose number is bounded by the calendar and not by the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, vocab
from ..functions.cells import without_nan


def by_month(df: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    """Rows, and per metric sum and non-null count, for each (year, month)."""
    dated = without_nan(df.select(date, *values)).where(F.col(date).isNotNull())
    return (dated.groupBy(F.year(date).alias("year"), F.month(date).alias("month"))
            .agg(F.count("*").alias("row_count"), *[
                F.struct(F.sum(F.col(v).cast("double")).alias("total"),
                         F.count(v).alias("count")).alias(f"m_{i}")
                for i, v in enumerate(values)]))


def _label(year: Column | str = "year", month: Column | str = "month") -> Column:
    return F.format_string("%d-%02d", F.col(year), F.col(month))


def flag_volume(periods: DataFrame, count: str = "row_count",
                z_threshold: float = vocab.VOLUME_Z) -> DataFrame:
    """Add z-score, spike flag and the mean of the periods with another row count."""
    every = Window.partitionBy(F.lit(0))  # one row per calendar period
    same = Window.partitionBy(count)
    n, total, std = F.count("*").over(every), F.sum(count).over(every), \
        F.stddev_pop(count).over(every)
    z = F.try_divide(F.col(count) - F.avg(count).over(every), std)
    flag = (n >= vocab.VOLUME_MIN_PERIODS) & (std > 0) & (z > z_threshold)
    others = F.try_divide(total - F.sum(count).over(same), n - F.count("*").over(same))
    return periods.withColumns({"z_score": z, "is_volume_anomaly": F.coalesce(flag, F.lit(False)),
                                "avg_other_periods": others})


def volume_anomalies(df: DataFrame, date: str) -> DataFrame:
    """Months holding suspiciously many rows."""
    flagged = flag_volume(by_month(df, date, [])).where("is_volume_anomaly")
    return flagged.select(
        F.lit(date).alias("date_column"), _label().alias("period"), "row_count",
        F.round("z_score", 2).alias("z_score"),
        F.round("avg_other_periods", 1).alias("avg_other_periods"))


def monthly_rows(df: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    """Long form: one unrounded row per metric and month, spikes flagged."""
    wide = flag_volume(by_month(df, date, values))
    structs = [F.struct(F.lit(v).alias("value_column"), F.col(f"m_{i}.total").alias("sum_value"),
                        F.col(f"m_{i}.count").alias("n_values")) for i, v in enumerate(values)]
    long = wide.select("year", "month", "is_volume_anomaly", F.inline(F.array(*structs)))
    enough = F.sum("n_values").over(Window.partitionBy("value_column"))
    return long.withColumn("_n", enough).where("_n >= 4 AND n_values > 0").drop("_n")


def monthly_totals(df: DataFrame, date: str, values: Sequence[str] | None = None) -> DataFrame:
    """Sum, mean and count of each metric per calendar month."""
    values = list(values or names.numeric_columns(df))
    first = F.make_date("year", "month", F.lit(1))
    return monthly_rows(df, date, values).select(
        F.lit(date).alias("date_column"), "value_column", "year", "month",
        F.date_format(first, "MMM").alias("month_name"), _label().alias("year_month"),
        F.date_format(first, "MMM yyyy").alias("label"),
        F.round("sum_value", 2).alias("total"),
        F.round(F.col("sum_value") / F.col("n_values"), 2).alias("avg"),
        F.col("n_values").alias("count"), "is_volume_anomaly")


def _pct_change(new: Column, old: Column) -> Column:
    return F.round(F.try_divide(new - old, F.abs(old)) * 100, 1)


def period_changes(df: DataFrame, date: str, values: Sequence[str] | None = None) -> DataFrame:
    """Change from the first to the last valid year and between the last two months.

    Spike months are left out; a year counts once it holds enough of the remaining rows.
    """
    values = list(values or names.numeric_columns(df))
    months = monthly_rows(df, date, values)
    clean = months.where(~F.col("is_volume_anomaly"))
    yearly = clean.groupBy("value_column", "year").agg(
        F.sum("sum_value").alias("year_sum"), F.sum("n_values").alias("year_rows"))
    per_metric = Window.partitionBy("value_column")  # one row per calendar year
    needed = F.greatest(F.lit(vocab.MIN_PERIOD_ROWS), F.ceil(
        F.sum("year_rows").over(per_metric) * F.lit(vocab.MIN_PERIOD_SHARE))).cast("int")
    judged = yearly.withColumn("min_required", needed).withColumn(
        "valid", F.col("year_rows") >= F.col("min_required"))
    valid_year = F.when(F.col("valid"), F.col("year"))
    summary = judged.groupBy("value_column").agg(
        F.first("min_required").alias("min_required"), F.count_if("valid").alias("n_valid"),
        F.min(valid_year).alias("first_year"), F.max(valid_year).alias("last_year"),
        F.min_by("year_sum", valid_year).alias("first_sum"),
        F.max_by("year_sum", valid_year).alias("last_sum"),
        F.array_sort(F.collect_list(F.when(~F.col("valid"), F.struct("year", "year_rows"))))
        .alias("excluded"),
        F.collect_set("year").alias("years_seen"))
    lost = months.where("is_volume_anomaly").groupBy("value_column").agg(
        F.collect_set("year").alias("spike_years"))
    recent = (clean.join(summary.select("value_column", F.col("last_year").alias("year")),
                         ["value_column", "year"])
              .groupBy("value_column")
              .agg(F.slice(F.sort_array(F.collect_list(F.struct("month", "sum_value")), False),
                           1, 2).alias("two"))
              .where(F.size("two") == 2)
              .select("value_column", F.col("two")[0].sum_value.alias("this_month"),
                      F.col("two")[1].sum_value.alias("prior_month")))
    joined = (summary.join(lost, "value_column", "left").join(recent, "value_column", "left")
              .withColumn("years_lost", F.array_sort(F.array_except(
                  F.coalesce("spike_years", F.array().cast("array<int>")), "years_seen")))
              .withColumn("yoy", F.when(F.col("n_valid") >= 2,
                                        _pct_change(F.col("last_sum"), F.col("first_sum"))))
              .withColumn("mom", _pct_change(F.col("this_month"), F.col("prior_month"))))
    reported = joined.where("yoy IS NOT NULL OR mom IS NOT NULL OR size(excluded) > 0 "
                            "OR size(years_lost) > 0")
    return reported.select(
        F.col("value_column").alias("metric_column"), F.lit(date).alias("date_column"),
        F.col("yoy").alias("yoy_pct_change"), F.col("yoy").alias("first_last_year_pct"),
        F.col("mom").alias("mom_pct_change"), "n_valid", "first_year", "last_year",
        F.concat_ws(", ", F.transform("excluded", lambda e: e.year.cast("string")))
        .alias("excluded_years"),
        F.concat_ws(", ", F.transform("years_lost", lambda y: y.cast("string")))
        .alias("years_lost_to_volume_anomaly"),
        F.col("min_required").alias("min_sample_size_required"),
        _narrative().alias("summary"))


def _narrative() -> Column:
    title = F.initcap(F.replace(F.col("value_column"), F.lit("_"), F.lit(" ")))
    moved = (lambda c, up, down, flat: F.when(c > 0, up).when(c < 0, down).otherwise(flat))
    yoy = F.format_string(
        "%s: %s %.1f%% between %d (%s) and %d (%s); years with under %d rows and spike months are left out.",
        title, moved(F.col("yoy"), "up", "down", "unchanged,"), F.abs("yoy"), F.col("first_year"),
        F.format_number("first_sum", 2), F.col("last_year"), F.format_number("last_sum", 2), F.col("min_required"))
    sparse = F.when(F.size("excluded") > 0, F.concat(
        F.lit("too few rows in "), F.concat_ws(", ", F.transform("excluded", lambda e: F.format_string(
            "%d (%d)", e.year, e.year_rows)))))
    spiked = F.when(F.size("years_lost") > 0, F.concat(
        F.lit("only spike months in "), F.concat_ws(", ", F.transform("years_lost", lambda y: y.cast("string")))))
    skipped = F.format_string("%s: years not compared: %s.", title, F.concat_ws("; ", sparse, spiked))
    mom = F.format_string("Last month of %d against the one before: %s %.1f%%.", F.col("last_year"),
                          moved(F.col("mom"), "up", "down", "unchanged,"), F.abs("mom"))
    return F.concat_ws(
        " ",
        F.when(F.col("yoy").isNotNull(), yoy).when(
            (F.col("n_valid") < 2) & ((F.size("excluded") > 0) | (F.size("years_lost") > 0)),
            skipped),
        F.when(F.col("mom").isNotNull(), mom))


def best_worst_period(df: DataFrame, date: str, values: Sequence[str] | None = None) -> DataFrame:
    """Best and worst month of each metric among months holding enough rows and no spike."""
    values = list(values or names.numeric_columns(df))
    months = monthly_rows(df, date, values).where(
        (~F.col("is_volume_anomaly")) & (F.col("n_values") >= vocab.MIN_PERIOD_ROWS))
    best, worst = F.struct("sum_value", -F.col("year"), -F.col("month")), \
        F.struct("sum_value", "year", "month")
    return months.groupBy("value_column").agg(
        F.count("*").alias("reliable_periods"),
        F.max_by(_label(), best).alias("best_period"),
        F.round(F.max("sum_value"), 2).alias("best_total"),
        F.min_by(_label(), worst).alias("worst_period"),
        F.round(F.min("sum_value"), 2).alias("worst_total"))
