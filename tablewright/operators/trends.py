"""Row-rank trend lines, their edge windows, and linear forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, vocab
from ..functions.cells import without_nan
from ..session import written
from .profile import long_rows, percentile_columns
from .ranking import SINGLE_TASK_ROWS, rank_scan

PAIR = ["date_column", "value_column"]


def _dated(df: DataFrame, date: str, values: Sequence[str], *more: Column) -> tuple[DataFrame, list[str]]:
    """The rows with a date: ``moment``, its microseconds ``at`` and the values as numbers ``_y0, _y1, ...``."""
    moment = F.col(date).cast("timestamp")
    rows = (without_nan(df).where(F.col(date).isNotNull())
            .select(moment.alias("moment"), F.unix_micros(moment).alias("at"), *more,
                    *[F.col(v).cast("double").alias(f"_y{i}") for i, v in enumerate(values)]))
    return rows, [f"_y{i}" for i in range(len(values))]


def _per_pair(one: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    """The structs ``s0, s1, ...`` of one row as rows with the names of the columns."""
    return long_rows(one, [F.struct(F.lit(date).alias("date_column"), F.lit(v).alias("value_column"),
                                    F.col(f"s{i}").alias("s")) for i, v in enumerate(values)]).select(*PAIR, "s.*")


def _sign(c: Column) -> Column:
    return F.when(c > 0, "increasing").when(c < 0, "decreasing").otherwise("flat")


def _edges_and_lines(df: DataFrame, date: str, values: Sequence[str], key: Sequence[str],
                     single_task_rows: int) -> DataFrame:
    """Per value column: rows, edge width, deviation, line over the places, means of both edges."""
    rows, ys = _dated(df, date, values, F.struct(*key).alias("key"))
    placed = rank_scan(rows, ["moment", "key"], "at", ys, single_task_rows)
    found = []
    for i, y in enumerate(ys):
        x, n = F.col(f"_x{i}"), F.col(f"_n{i}")
        width = F.greatest(F.lit(vocab.EDGE_MIN_ROWS), F.ceil(n * F.lit(vocab.EDGE_SHARE)))
        width = F.greatest(F.least(width, F.floor(n / 2)), F.lit(1))
        found.append(F.struct(
            F.max(n).alias("n"), F.max(width).alias("w"), F.stddev_pop(y).alias("std"),
            F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"),
            F.avg(F.when(x < width, F.col(y))).alias("start"),
            F.avg(F.when(x >= n - width, F.col(y))).alias("end")).alias(f"s{i}"))
    return _per_pair(placed.agg(*found), date, values)


def trends(df: DataFrame, key: Sequence[str], dates: Sequence[str] | None = None,
           values: Sequence[str] | None = None,
           single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Fit every numeric column against the row's place in date order.

    ``key`` breaks equal dates and should be unique. Start and end are means over windows at
    both edges, so a single stray row never becomes the headline change.
    """
    dates = list(dates or names.date_columns(df))
    values = list(values or names.numeric_columns(df))
    fit = reduce(DataFrame.unionByName, [_edges_and_lines(df, d, values, key, single_task_rows) for d in dates])
    enough = F.col("w") >= vocab.EDGE_MIN_ROWS
    change = F.when(enough, F.try_divide(F.col("end") - F.col("start"), F.abs("start")) * 100)
    fit = fit.where("n >= 5 AND std > 0").withColumn("change", change)
    by_slope = _sign(F.col("slope"))
    direction = F.when(F.col("change").isNotNull(), _sign(F.col("change"))).otherwise(by_slope)
    conflict = (F.col("change").isNotNull() & (by_slope != direction) & (by_slope != "flat")
                & (direction != "flat"))
    return fit.select(
        *PAIR, direction.alias("direction"), by_slope.alias("slope_direction"),
        conflict.alias("direction_conflict"),
        F.when(F.col("r2") >= 0.5, "strong").when(F.col("r2") >= 0.2, "moderate")
        .otherwise("weak").alias("strength"),
        F.round("r2", 3).alias("r_squared"),
        F.round("change", 1).alias("pct_change_start_to_end"),
        F.round("start", 2).alias("start_value"), F.round("end", 2).alias("end_value"),
        F.col("w").cast("long").alias("start_sample_size"),
        F.col("w").cast("long").alias("end_sample_size"),
        (~enough).alias("insufficient_edge_data"), F.col("n").alias("total_sample_size"))


def best_trend(found: DataFrame) -> DataFrame:
    """The best-fitting trend, one with sufficient edges before any other."""
    return found.orderBy("insufficient_edge_data", F.desc("r_squared"), *PAIR).limit(1)


def _forecast_fits(df: DataFrame, date: str, values: Sequence[str], min_points: int,
                   min_r_squared: float, single_task_rows: int) -> tuple[DataFrame, DataFrame]:
    """(mean of each value per moment, fitted line per value column) for one date column."""
    rows, ys = _dated(df, date, values)
    # used for counting, ordering, fitting and as the history
    moments = written(rows.groupBy("moment", "at").agg(*[F.avg(y).alias(y) for y in ys]))
    series = rank_scan(moments, ["at"], "at", ys, single_task_rows)
    steps = [f"_gap{i}" for i in range(len(ys))]
    series = series.withColumns({g: F.when(F.col(y).isNotNull(), F.col(g)) for g, y in zip(steps, ys)})
    middle = percentile_columns(series, steps, [0.5], moments.count())
    found = []
    for i, y in enumerate(ys):
        x = F.when(F.col(y).isNotNull(), F.col(f"_x{i}"))
        found.append(F.struct(
            F.max(f"_n{i}").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"), F.stddev_pop(y).alias("std"), F.max_by("moment", x).alias("last_at"),
            F.max_by(y, x).alias("last_y"), F.round(middle[steps[i]][0]).cast("long").alias("step")).alias(f"s{i}"))
    fits = (_per_pair(series.agg(*found), date, values)
            .where((F.col("n") >= min_points) & (F.col("std") > 0) & (F.col("r2") >= min_r_squared))
            .withColumn("residual_std", F.col("std") * F.sqrt(F.greatest(1 - F.col("r2"), F.lit(0.0)))))
    return series, fits


def forecast_summary(df: DataFrame, dates: Sequence[str] | None = None,
                     values: Sequence[str] | None = None, periods_ahead: int = 5,
                     min_points: int = 8, min_r_squared: float = 0.1,
                     single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Projected end value and change for every pair whose line explains enough."""
    dates = list(dates or names.date_columns(df))
    values = list(values or names.numeric_columns(df))
    fits = reduce(DataFrame.unionByName, [
        _forecast_fits(df, d, values, min_points, min_r_squared, single_task_rows)[1] for d in dates])
    end = F.col("intercept") + F.col("slope") * (F.col("n") + periods_ahead - 1)
    change = F.try_divide(end - F.col("last_y"), F.abs("last_y")) * 100
    return fits.select(
        *PAIR, F.round("r2", 3).alias("r_squared"), F.round("slope", 4).alias("slope_per_period"),
        F.lit(periods_ahead).alias("periods_ahead"), F.round(end, 2).alias("projected_end_value"),
        F.round(change, 1).alias("pct_projected_change"))


def best_forecast(df: DataFrame, **options) -> DataFrame:
    """The forecast whose line fits best over all date and numeric columns."""
    return forecast_summary(df, **options).orderBy(F.desc("r_squared"), *PAIR).limit(1)


def forecast(df: DataFrame, date: str, value: str, periods_ahead: int = 5, min_points: int = 8,
             min_r_squared: float = 0.1, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """History and projected points with a 95% band; no rows if the line explains too little."""
    series, fits = _forecast_fits(df, date, [value], min_points, min_r_squared, single_task_rows)
    y = F.col("_y0")
    history = series.where(y.isNotNull()).join(F.broadcast(fits.select("n")), F.col("n") > 0, "left_semi").select(
        "moment", y.alias("value"), y.alias("lower_bound"), y.alias("upper_bound"), F.lit("historical").alias("type"))
    ahead = fits.select("*", F.explode(F.sequence(F.lit(0), F.lit(periods_ahead - 1))).alias("i"))
    y = F.col("intercept") + F.col("slope") * (F.col("n") + F.col("i"))
    band = F.col("residual_std") * 1.96
    at = F.timestamp_micros(F.unix_micros("last_at") + F.col("step") * (F.col("i") + 1))
    future = ahead.select(at.alias("moment"), y.alias("value"), (y - band).alias("lower_bound"),
                          (y + band).alias("upper_bound"), F.lit("forecast").alias("type"))
    return history.unionByName(future).select(
        "moment", *[F.round(c, 6).alias(c) for c in ("value", "lower_bound", "upper_bound")], "type")
