"""Segment comparisons: benchmarks, ratios, concentration, leaders and stakes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.cells import without_nan
from ..session import written
from .ranking import SINGLE_TASK_ROWS, global_index, sum_before
from .statistics import kpis


def by_segment(df: DataFrame, segment: str, metric: str) -> DataFrame:
    """Sum, mean and row count of a metric per segment value."""
    return (without_nan(df).where(F.col(segment).isNotNull() & F.col(metric).isNotNull())
            .groupBy(F.col(segment).cast("string").alias("segment"))
            .agg(F.sum(F.col(metric).cast("double")).alias("total"),
                 F.count("*").alias("row_count"))
            .withColumn("mean", F.col("total") / F.col("row_count")))


def benchmark(df: DataFrame, segment: str, metric: str) -> DataFrame:
    """Each segment against the average segment, by total and by mean."""
    grouped = by_segment(df, segment, metric)
    average = grouped.agg(F.struct(F.avg("total").alias("total"), F.avg("mean").alias("mean")))
    against = grouped.withColumn("_avg", average.scalar())
    return against.select(
        "segment", F.round("total", 2).alias("total"), F.round("mean", 2).alias("mean"),
        "row_count", F.round("_avg.total", 2).alias("average_segment_total"),
        F.round((F.try_divide("total", "_avg.total") - 1) * 100, 1).alias("total_vs_average_pct"),
        F.round((F.try_divide("mean", "_avg.mean") - 1) * 100, 1).alias("mean_vs_average_pct"))


def per_unit_ratios(df: DataFrame, segment: str, metric: str, units: str | None = None,
                    discount: str | None = None, member: str | None = None) -> DataFrame:
    """Metric per row, per unit and per member; ``discount`` is a rate, given as % of metric."""
    clean = without_nan(df)
    metric_value = F.col(metric).cast("double")
    parts = [F.sum(metric_value).alias("total"), F.count(metric).alias("row_count")]
    if units:
        parts.append(F.sum(F.col(units).cast("double")).alias("units"))
    if discount:
        parts.append(F.sum(metric_value * F.col(discount)).alias("discounted"))
    if member:
        parts.append(F.count_distinct(member).alias("members"))
    grouped = (clean.where(F.col(segment).isNotNull())
               .groupBy(F.col(segment).cast("string").alias("segment")).agg(*parts))
    ratio = (lambda c: F.round(F.try_divide("total", c), 2))
    return grouped.select(
        "segment", F.round("total", 2).alias("total"), "row_count",
        ratio("row_count").alias("per_row"),
        *([ratio("units").alias("per_unit")] if units else []),
        *([F.round(F.try_divide("discounted", "total") * 100, 1).alias("discount_pct")]
          if discount else []),
        *([F.col("members"), ratio("members").alias("per_member")] if member else []))


def skew_gap(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Gap between mean and median of every KPI, notable above 15% of the median."""
    gap = F.try_divide(F.col("mean") - F.col("median"), F.abs("median"))
    return kpis(df, None, exclude).select(
        "column", "mean", "median", F.round(gap * 100, 1).alias("gap_pct"),
        F.coalesce(F.abs(gap) > vocab.SKEW_GAP_SHARE, F.lit(False)).alias("notable"))


def concentration(df: DataFrame, segment: str, metric: str) -> DataFrame:
    """Share of the metric against share of the rows; the leader above 40% is a dependency."""
    grouped = by_segment(df, segment, metric)
    whole = grouped.agg(F.struct(F.sum("total").alias("total"), F.sum("row_count").alias("rows"),
                                 F.max(F.struct("total", F.col("segment"))).alias("top")))
    shares = grouped.withColumn("_all", whole.scalar())
    pct = F.try_divide("total", "_all.total") * 100
    return shares.select(
        "segment", F.round("total", 2).alias("total"), F.round(pct, 1).alias("metric_pct"),
        F.round(F.try_divide("row_count", "_all.rows") * 100, 1).alias("row_pct"),
        ((F.col("total") == F.col("_all.top.total")) & (pct > vocab.CONCENTRATION_PCT))
        .alias("dependency_risk"))


def _with_rank(grouped: DataFrame, measure: str, rank: str, single_task_rows: int) -> DataFrame:
    """Descending rank, ties sharing the best place, for any number of segments."""
    placed = global_index(grouped.groupBy(measure).agg(F.count("*").alias("_ties")),
                          [F.desc(measure)], "_index", single_task_rows)
    more = sum_before(placed, "_index", "_ties", single_task_rows)
    return grouped.join(more.select(measure, (F.col("_before") + 1).alias(rank)), measure)


def volume_value_leaders(df: DataFrame, segment: str, metric: str,
                         single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Rank of each segment by rows and by value, and whether the same one leads both.

    Value is the total as shown: the last digits of a sum depend on the order of its rows, so equal
    segments would be apart by chance. The segments are written once, as ranks are joined on them.
    """
    grouped = written(by_segment(df, segment, metric).withColumn("total", F.round("total", 2)))
    both = _with_rank(_with_rank(grouped, "row_count", "volume_rank", single_task_rows),
                      "total", "value_rank", single_task_rows)
    return both.select("segment", "row_count", "total",
                       F.col("volume_rank").cast("long").alias("volume_rank"),
                       F.col("value_rank").cast("long").alias("value_rank"),
                       ((F.col("volume_rank") == 1) & (F.col("value_rank") == 1))
                       .alias("leads_both"))


def share_shift_stake(df: DataFrame, segment: str, metric: str) -> DataFrame:
    """What a segment would add if its share rose to the leader's share."""
    grouped = by_segment(df, segment, metric)
    whole = grouped.agg(F.struct(F.sum("total").alias("total"), F.max("total").alias("top")))
    shares = grouped.withColumn("_all", whole.scalar())
    own, top = F.try_divide("total", "_all.total"), F.try_divide("_all.top", "_all.total")
    return shares.select(
        "segment", F.round(own * 100, 1).alias("share_pct"),
        F.round(top * 100, 1).alias("top_share_pct"),
        F.round((top - own) * F.col("_all.total"), 2).alias("stake"))
