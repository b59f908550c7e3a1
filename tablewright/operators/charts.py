"""The aggregated frame behind each chart. Drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, vocab
from ..functions.cells import format_value, loose_number, nan_to_null
from .statistics import category_summary, chart_columns, kpis


def is_numeric(df: DataFrame, column: str) -> bool:
    """Numeric by type, or text of which at least 80% reads as a number."""
    if column in names.numeric_columns(df):
        return True
    share = df.agg(F.avg(loose_number(F.col(column)).isNotNull().cast("double"))).first()[0]
    return (share or 0.0) >= vocab.LOOSE_NUMERIC_SHARE


def as_number(df: DataFrame, column: str) -> Column:
    """The column as a number, text coerced loosely."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        return loose_number(F.col(column))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return nan_to_null(F.col(column))
    return F.col(column).cast("double")


def _grouped(df: DataFrame, x: str, y: str | None, how, k: int) -> DataFrame:
    """Top k groups by the aggregate of y, or by row count without a numeric y."""
    present = df.where(F.col(x).isNotNull())
    if y is not None and y in df.columns and is_numeric(df, y):
        result = present.groupBy(F.col(x).alias("x")).agg(how(as_number(df, y)).alias("value"))
    else:
        result = present.groupBy(F.col(x).alias("x")).agg(
            F.count("*").cast("double").alias("value"))
    return (result.orderBy(F.desc("value"), "x").limit(k)
            .select("x", F.round("value", 2).alias("value")))


def pie(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Eight largest slices by sum (or count)."""
    return _grouped(df, x, y, F.sum, 8)


def bar(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Twelve highest means (or counts)."""
    return _grouped(df, x, y, F.avg, 12)


def column(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Fifteen highest means (or counts)."""
    return _grouped(df, x, y, F.avg, 15)


def stacked_bar(df: DataFrame, x: str, color: str | None, y: str | None = None) -> DataFrame:
    """Sum (or count) per x and colour; a plain column chart without a colour."""
    if color is None or color not in df.columns:
        return column(df, x, y)
    if y is not None and y in df.columns and is_numeric(df, y):
        value = F.sum(as_number(df, y))
        present = df.na.drop(subset=[x, color, y])
    else:
        value = F.count("*").cast("double")
        present = df.na.drop(subset=[x, color])
    return (present.groupBy(F.col(x).alias("x"), F.col(color).alias("color"))
            .agg(F.round(value, 2).alias("value")))


def line(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame | None:
    """Mean of y at each x (and colour), in x order; None if y is not numeric."""
    if not is_numeric(df, y):
        return None
    keys = {"x": x} | ({"color": color} if color in df.columns else {})
    present = df.na.drop(subset=[y, *keys.values()])
    return (present.groupBy(*[F.col(c).alias(k) for k, c in keys.items()])
            .agg(F.round(F.avg(as_number(df, y)), 6).alias("value")).orderBy(*keys))


def scatter(df: DataFrame, x: str, y: str, key: Sequence[str], points: int = 3000,
            color: str | None = None) -> DataFrame:
    """A repeatable sample of at most ``points`` rows, chosen by the hash of the row key."""
    shown = df.select(*key, as_number(df, x).alias("x"), as_number(df, y).alias("y"),
                      *([F.col(color).alias("color")] if color else [])).na.drop(subset=["x", "y"])
    draw = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return shown.orderBy(draw, *key).limit(points)


def scatter_line(df: DataFrame, x: str, y: str, points: int = 50) -> DataFrame:
    """Least-squares line over all rows at evenly spaced x, from at least three rows."""
    pairs = df.select(as_number(df, x).alias("x"), as_number(df, y).alias("y")).na.drop()
    fit = pairs.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"),
                    F.regr_intercept("y", "x").alias("intercept"), F.min("x").alias("low"),
                    F.max("x").alias("high")).where("n >= 3 AND slope IS NOT NULL")
    step = (F.col("high") - F.col("low")) / (points - 1)
    at = F.col("low") + step * F.col("i")
    return (fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
            .select(F.col("i").alias("point"), F.round(at, 4).alias("x"),
                    F.round(F.col("intercept") + F.col("slope") * at, 4).alias("y")))


def histogram(df: DataFrame, x: str, bins: int = 30) -> DataFrame:
    """Row counts in equal-width bins between minimum and maximum, with the overall mean."""
    values = df.select(as_number(df, x).alias("v")).where("v IS NOT NULL")
    low, high, mean = values.agg(F.min("v"), F.max("v"), F.round(F.avg("v"), 2)).first()
    if low is None:
        return df.sparkSession.createDataFrame(
            [], "bin int, bin_start double, bin_end double, count bigint, mean double")
    width = (high - low) / bins
    slot = (F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)) if width
            else F.lit(0)).cast("int")
    return (values.groupBy(slot.alias("bin")).agg(F.count("*").alias("count"))
            .select("bin", F.round(F.lit(low) + F.col("bin") * width, 4).alias("bin_start"),
                    F.round(F.lit(low) + (F.col("bin") + 1) * width, 4).alias("bin_end"),
                    "count", F.lit(mean).alias("mean")).orderBy("bin"))


def trend_rollup(df: DataFrame, date: str, value: str) -> DataFrame:
    """Yearly sums when more than two years are present, monthly sums otherwise."""
    monthly = (df.select(F.to_date(F.col(date)).alias("d"), as_number(df, value).alias("v"))
               .na.drop().groupBy(F.year("d").alias("y"), F.month("d").alias("m"))
               .agg(F.sum("v").alias("v")))
    annual = monthly.agg((F.count_distinct("y") > 2).alias("annual"))
    label = F.when(F.col("annual"), F.col("y").cast("string")).otherwise(
        F.format_string("%d-%02d", "y", "m"))
    return (monthly.withColumn("annual", annual.scalar())
            .groupBy(label.alias("label"), F.when(F.col("annual"), "annual")
                     .otherwise("monthly").alias("granularity"))
            .agg(F.round(F.sum("v"), 2).alias("total")).orderBy("label"))


def leading_kpis(df: DataFrame) -> list[dict]:
    """KPIs by spread, repeating keys of other tables last: the spread of a key grows with its table."""
    found = [r.asDict() for r in kpis(df, None).collect()]  # one row per numeric column
    return sorted(found, key=lambda k: names.is_key_name(k["column"]))[:vocab.MAX_KPIS]


def category_breakdown(df: DataFrame, max_columns: int = 3, top_groups: int = 10) -> DataFrame:
    """Mean of the leading KPI per group, for the first readable category columns."""
    schema = "column string, category string, mean double"
    leading = next(iter(leading_kpis(df)), None)
    usable = {r["column"] for r in chart_columns(df).where(
        "eligible AND unique_values >= 2").collect()}
    chosen = [c for c in names.text_columns(df) if c in usable][:max_columns]
    if leading is None or not chosen:
        return df.sparkSession.createDataFrame([], schema)
    value = as_number(df, leading["column"])
    long = (df.select(value.alias("v"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("category")) for c in chosen])))
        .where("category IS NOT NULL").groupBy("column", "category").agg(F.avg("v").alias("v")))
    order = Window.partitionBy("column").orderBy(F.desc("v"), "category")  # 12 groups at most
    return (long.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top_groups)
            .select("column", "category", F.round("v", 2).alias("mean")))


def kpi_strip(df: DataFrame, entity_plural: str = "Records", trend: DataFrame | None = None) \
        -> DataFrame:
    """Four cards: the total, a second distinct metric, the volume, the leading segment.

    Only a column that is revenue by its name is called revenue; otherwise the strip leads
    with the best KPI under its own label. ``trend`` is the trends frame, used for the growth
    fallback of the last card.
    """
    spark = df.sparkSession
    figures = leading_kpis(df)
    if not figures:
        return spark.createDataFrame([], "card int, title string, value double, caption string")
    revenue = next((k for k in figures if names.is_revenue_name(k["column"])), None)
    ranked = sorted(figures, key=lambda k: (names.is_key_name(k["column"]), not names.has_fragment(
        k["column"], vocab.PRIORITY_FRAGMENTS)))
    lead = revenue or ranked[0]
    rest = [k for k in ranked if k["column"] != lead["column"]]
    label, prefix = names.business_label(lead["column"])
    cards = [(1, "TOTAL REVENUE" if revenue else f"TOTAL {label.upper()}", lead["sum"], prefix,
              None)]
    if revenue or not rest:
        title = "AVG ORDER VALUE" if revenue else f"AVG {label.upper()}"
        cards.append((2, title, lead["mean"], prefix, lead["median"]))
    else:
        second, second_prefix = names.business_label(rest[0]["column"])
        cards.append((2, f"AVG {second.upper()}", rest[0]["mean"], second_prefix, None))
    n_rows = df.count()
    cards.append((3, f"TOTAL {entity_plural.upper()}", float(n_rows), "", None))
    shown = spark.createDataFrame(
        cards, "card int, title string, value double, prefix string, median double")
    caption = (F.when(F.col("median").isNotNull(),
                      F.concat(F.lit("Median "), format_value(F.col("median"), prefix)))
               .when(F.col("card") == 3, "Records analyzed"))
    text = (F.when(F.col("card") == 3, F.format_number("value", 0))
            .when(F.col("prefix") == "$", format_value(F.col("value"), "$"))
            .otherwise(format_value(F.col("value"))))
    top = shown.select("card", "title", F.round("value", 2).alias("value"), text.alias("shown"),
                       caption.alias("caption"))
    return top.unionByName(_last_card(df, lead, rest, label, prefix, n_rows, entity_plural, trend))


def _last_card(df, lead, rest, label, prefix, n_rows, entity_plural, trend) -> DataFrame:
    readable = {r["column"] for r in chart_columns(df).where("eligible").collect()}
    segment = next((c for c in names.text_columns(df) if c in readable), None)
    if segment is not None:
        name = category_summary(df, 1, [segment]).first()["value"]
        amount = as_number(df, lead["column"])
        part = F.sum(F.when(F.col(segment) == name, amount))
        share = F.coalesce(F.try_divide(part, F.sum(amount)) * 100, F.lit(0.0))
        title = f"TOP {segment.replace('_', ' ').upper()}"
        return df.agg(F.lit(4).alias("card"), F.lit(title).alias("title"),
                      F.round(part, 2).alias("value"), F.lit(name).alias("shown"),
                      F.concat(format_value(part, prefix), F.lit(" · "),
                               F.format_string("%.1f%% of ", F.round(share, 1)),
                               F.lit(label.lower())).alias("caption"))
    growth = trend.where((F.col("value_column") == lead["column"])
                         & F.col("pct_change_start_to_end").isNotNull()).first() \
        if trend is not None else None
    if growth is not None:
        card = ("GROWTH RATE", growth["pct_change_start_to_end"],
                f"{growth['pct_change_start_to_end']:+.1f}%", f"{label} change over period")
    elif rest:
        second, _ = names.business_label(rest[0]["column"])
        card = (f"AVG {second.upper()}", rest[0]["mean"], f"{rest[0]['mean']:,.2f}", None)
    else:
        card = (f"TOTAL {entity_plural.upper()}", float(n_rows), f"{n_rows:,}",
                "No additional segment signal")
    return df.sparkSession.createDataFrame(
        [(4, *card)], "card int, title string, value double, shown string, caption string")

