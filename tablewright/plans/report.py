"""All statistics of one cleaned table, as a dictionary of result frames."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..operators import charts, clusters, periods, profile, statistics, trends


def full_report(df: DataFrame, key: Sequence[str], classification: DataFrame | None = None,
                row_id: str | None = None) -> dict[str, DataFrame]:
    """Every section of the statistics package; sections without a basis are left out.

    ``key`` breaks equal dates in trends; ``row_id``, if given, adds clusters. The frames are
    lazy apart from the few scalars they are built from, so only what is read is computed.
    """
    business = set(names.business_columns(df.columns))  # no row numbers, hashes or date parts
    structural = [c for c in df.columns if c not in business]
    measures = [c for c in names.numeric_columns(df, structural) if c not in key]
    report = {
        "quality_score": statistics.quality_score(df),
        "kpis": statistics.kpis(df, exclude=structural),
        "correlations": statistics.correlations(df, exclude=structural),
        "anomalies": statistics.anomalies(df, exclude=structural),
        "column_profile": profile.column_profile(df),
        "column_roles": profile.column_roles(df),
    }
    if names.text_columns(df):
        report["category_summary"] = statistics.category_summary(df)
        report["chart_columns"] = statistics.chart_columns(df)
    by_status = statistics.revenue_by_status(df, classification=classification)
    if by_status is not None:
        report["revenue_by_status"] = by_status
    found = None
    for date in names.date_columns(df):
        report[f"monthly_totals:{date}"] = periods.monthly_totals(df, date, measures)
        report[f"volume_anomalies:{date}"] = periods.volume_anomalies(df, date)
        report[f"period_changes:{date}"] = periods.period_changes(df, date, measures)
    if names.date_columns(df) and measures:
        found = trends.trends(df, key)
        report["trends"] = found
        report["best_trend"] = trends.best_trend(found)
        report["best_forecast"] = trends.best_forecast(df, values=measures)
    report["kpi_strip"] = charts.kpi_strip(df.select(*[c for c in df.columns if c in business]), trend=found)
    if row_id is not None:
        report["segments"] = clusters.segments(df, row_id)
    return report


def value_rows(report: dict[str, DataFrame]) -> DataFrame:
    """Every number of the sections: section, item (its texts, by column name), measure, value."""
    parts = []
    for section, frame in report.items():
        numbers = [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType)]
        texts = sorted(c for c in frame.columns if c not in numbers)
        item = F.concat_ws(" / ", *[F.col(c).cast("string") for c in texts])
        parts.append(frame.select(F.lit(section).alias("section"), item.alias("item"),
                                  *[F.col(c).cast("double").alias(c) for c in numbers])
                     .unpivot(["section", "item"], numbers, "measure", "value").where("value IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)
