"""Column rewrites on whole frames; each decides on the data, then is a plain projection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, dates, names, vocab
from ..functions.counts import cells_where, value_counts
from ..session import written
from .profile import long_rows, percentile_columns
from .similarity import apply_map


def drop_columns(df: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """The frame without those columns, and the requested names it does not have."""
    columns = list(columns)
    return (df.drop(*[c for c in columns if c in df.columns]),
            [c for c in columns if c not in df.columns])


def standardise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*names.standard_names(df.columns))


def sweep_nulls(df: DataFrame) -> DataFrame:
    """Null for every "no value" spelling in the text columns."""
    text = names.text_columns(df)
    return df.withColumns({c: cells.sweep_nulls(F.col(c)) for c in text}) if text else df


def numeric_text_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: values, share that reads as a number, currency signs, whole numbers."""
    columns = list(columns if columns is not None else names.text_columns(df))
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, n_values bigint, n_numbers bigint, numeric_share double, "
                "n_currency bigint, whole boolean, to_number boolean")
    return numbers_of_counts(value_counts(df, columns), columns)


def numbers_of_counts(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same from the counts of the distinct values of the columns."""
    value = F.col("value")
    found = counts.groupBy("column").agg(
        cells_where(~cells.is_null_marker(value)).alias("n"), cells_where(cells.parse_number(value).isNotNull()).alias("k"),
        cells_where(cells.has_currency_sign(value)).alias("signs"), F.bool_and(cells.parse_number(value) % 1 == 0).alias("whole"))
    wanted = counts.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    none = F.lit(0).cast("bigint")
    share = F.coalesce(F.try_divide(F.col("k") * 1.0, F.col("n")), F.lit(0.0))
    return wanted.join(F.broadcast(found), "column", "left").select(  # one row per column
        "column", F.coalesce("n", none).alias("n_values"), F.coalesce("k", none).alias("n_numbers"),
        F.round(share, 4).alias("numeric_share"), F.coalesce("signs", none).alias("n_currency"),
        F.coalesce("whole", F.lit(True)).alias("whole"), (share > vocab.NUMERIC_SHARE).alias("to_number"))


def convert_numbers(df: DataFrame, columns: Sequence[str] | None = None,
                    min_currency_share: float = 0.0) -> DataFrame:
    """Text columns that are numbers, or carry a currency sign, become bigint or double.

    ``min_currency_share`` raises the bar from "any cell with a sign" to a share of the cells.
    """
    found = numeric_text_profile(df, columns).collect()  # one row per column
    typed = {}
    for r in found:
        money = r["n_currency"] > min_currency_share * r["n_values"]
        if r["n_values"] and (r["to_number"] or money):
            number = cells.parse_number(F.col(r["column"]))
            typed[r["column"]] = number.cast("bigint") if r["whole"] else number
    return df.withColumns(typed) if typed else df


def date_candidates(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Formats for those text columns whose name or contents say they hold dates.

    Each distinct cell is looked at once.
    """
    columns = [c for c in columns if not dates.name_is_duration(c)]
    return date_columns_of(written(value_counts(df, columns)), columns) if columns else {}


def date_columns_of(counts: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The same from the counts of the distinct values of the columns.

    Cheap content tests run for all columns in one pass; the format ladder runs only for the
    columns that pass them.
    """
    columns = [c for c in columns if not dates.name_is_duration(c)]
    evidence = {r["column"]: r for r in counts.where(F.col("column").isin(columns)).groupBy("column").agg(
        *dates.shape_evidence(F.col("value"))).collect()}  # one row per column
    plausible = [c for c in columns if c in evidence and dates.may_be_dates(c, evidence[c])]
    fits = dates.fit_counts(counts, plausible) if plausible else {}
    return {c: found for c, fit in fits.items()
            if fit.is_candidate and (found := fit.formats()) is not None}


def convert_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns that hold dates become calendar dates; timestamps lose their time of day."""
    chosen = date_candidates(df, list(columns if columns is not None else names.text_columns(df)))
    typed = {c: dates.parse_date(F.col(c), f) for c, f in chosen.items()}
    typed |= {c: F.to_date(F.col(c)) for c in names.date_columns(df)}
    return df.withColumns(typed) if typed else df


def date_part_columns(df: DataFrame) -> dict[str, bool]:
    """Date columns to split, with whether month parts are worth adding.

    A column needs two distinct dates; birth dates and record metadata are never split.
    """
    columns = [c for c in names.date_columns(df)
               if not names.has_fragment(c, vocab.NO_SPLIT_FRAGMENTS)]
    if not columns:
        return {}
    row = df.agg(*[F.struct(F.min(F.to_date(c)) != F.max(F.to_date(c)),
                            F.min(F.month(c)) != F.max(F.month(c)),
                            F.min(F.year(c)) != F.max(F.year(c))).alias(f"c{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: bool(row[f"c{i}"][1] or row[f"c{i}"][2])
            for i, c in enumerate(columns) if row[f"c{i}"][0]}


def add_date_parts(df: DataFrame, parts: dict[str, bool]) -> DataFrame:
    """Year, and month with its name derived from the same number, replacing stale ones."""
    for c, months in parts.items():
        df = df.drop(*[c + suffix for suffix in vocab.DERIVED_SUFFIXES])
        df = df.withColumn(f"{c}_year", F.year(c))
        if months:
            df = df.withColumns({f"{c}_month": F.month(c),
                                 f"{c}_month_name": F.date_format(c, "MMMM")})
    return df


def split_dates(df: DataFrame) -> DataFrame:
    return add_date_parts(df, date_part_columns(df))


def clean_text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Universal text cleaning; ``exclude`` protects codes whose dashes or points matter."""
    text = [c for c in names.text_columns(df, exclude) if not c.endswith("_month_name")]
    return df.withColumns({c: cells.clean_text(F.col(c)) for c in text}) if text else df


def boolean_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Text columns holding only yes/no words."""
    columns = list(columns if columns is not None else names.text_columns(df))
    if not columns:
        return []
    row = df.agg(*[F.bool_and(cells.is_boolean_word(F.col(c))).alias(f"c{i}")
                   for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"c{i}"]]


def normalise_booleans(df: DataFrame) -> DataFrame:
    found = boolean_columns(df)
    return df.withColumns({c: cells.yes_no(F.col(c)) for c in found}) if found else df


def null_corrupted_ids(df: DataFrame) -> DataFrame:
    """In text columns named like digit-only identifiers, anything else becomes null."""
    ids = [c for c in names.text_columns(df) if names.is_digit_identifier(c)]
    return df.withColumns({c: cells.digits_only(F.col(c)) for c in ids}) if ids else df


def rating_scales(df: DataFrame) -> DataFrame:
    """Scale of each rating column, read from its own values: lower end 0 or 1, upper end snapped."""
    columns = [c for c in names.numeric_columns(df) if names.bound_rule(c) == "rating"]
    schema = "column string, scale_min double, scale_max double"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    one = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double")
                            .alias("hi")).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = long_rows(one, [F.struct(F.lit(c).alias("column"), F.col(f"c{i}.lo").alias("lo"),
                                    F.col(f"c{i}.hi").alias("hi"))
                           for i, c in enumerate(columns)])
    low, high = F.col("lo"), F.col("hi")
    ceiling = F.coalesce(*[F.when(high <= c, c) for c in vocab.RATING_CEILINGS],
                         F.when(high > 0, F.round(high * 1.1, 1)), F.lit(vocab.RATING_DEFAULT[1]))
    return rows.select(
        "column", F.when(low.isNull(), vocab.RATING_DEFAULT[0]).when(low <= 0, 0.0)
        .otherwise(1.0).alias("scale_min"),
        F.when(high.isNull(), vocab.RATING_DEFAULT[1]).otherwise(ceiling).alias("scale_max"))


def domain_bounds(df: DataFrame, scales: dict[str, tuple[float, float]]) \
        -> dict[str, tuple[float | None, float | None]]:
    """(low, high) that a column's name implies; ratings use their own scale."""
    bounds: dict[str, tuple[float | None, float | None]] = {}
    for c in names.numeric_columns(df):
        rule = names.bound_rule(c)
        if rule == "rating":
            bounds[c] = scales.get(c, vocab.RATING_DEFAULT)
        elif rule == "percent":
            bounds[c] = vocab.PERCENT_RANGE
        elif rule == "non_negative":
            bounds[c] = (0.0, None)
    return bounds


def clip_columns(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Limit columns to their bounds, keeping each column's type and its nulls.

    A whole-number column with a fractional bound widens to double.
    """
    types = dict(df.dtypes)
    clipped = {}
    for c, (low, high) in bounds.items():
        limited = cells.clip(F.col(c), low, high)
        whole = all(b is None or float(b).is_integer() for b in (low, high))
        clipped[c] = limited.cast(types[c]) if whole else limited.cast("double")
    return df.withColumns(clipped) if clipped else df


def clip_domains(df: DataFrame) -> DataFrame:
    """Ratings to their scale, percentages to 0..100, quantities that cannot be negative to 0."""
    scales = {r["column"]: (r["scale_min"], r["scale_max"]) for r in rating_scales(df).collect()}
    return clip_columns(df, domain_bounds(df, scales))


def outlier_bounds(df: DataFrame, scales: dict[str, tuple[float, float]] | None = None) \
        -> dict[str, tuple[float, float]]:
    """Three interquartile ranges around the quartiles, for columns with over five values.

    Only columns holding something outside their bounds are returned.
    """
    columns = names.numeric_columns(df)
    if not columns:
        return {}
    scales = scales or {}
    quartiles = percentile_columns(df, columns, [0.25, 0.75], df.count())
    row = df.agg(*[F.struct(*quartiles[c], F.approx_count_distinct(c), F.min(c),
                            F.max(c)).alias(f"c{i}")
                   for i, c in enumerate(columns)]).first()
    bounds = {}
    for i, c in enumerate(columns):
        q1, q3, about, smallest, largest = row[f"c{i}"]
        if q1 is None or q3 == q1:
            continue
        # the sketch is exact for a handful of values; near the limit they are counted
        if about <= 20 and df.select(c).na.drop().distinct().limit(6).count() <= 5:
            continue
        low, high = q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)
        if names.floor_at_zero(c):
            low = max(low, 0.0)
        if c in scales:
            low, high = max(low, scales[c][0]), min(high, scales[c][1])
        if smallest < low or largest > high:
            bounds[c] = (float(low), float(high))
    return bounds


def cap_outliers(df: DataFrame, scales: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    return clip_columns(df, outlier_bounds(df, scales))


def map_values(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply a supplied (column, dirty, canonical) table; the frame keeps its columns.

    One join per mapped column, on entries that change something.
    """
    mapped = [r["column"] for r in mapping.select("column").distinct().collect()]
    for c in mapped:
        if c in df.columns:
            df = apply_map(df, c, mapping.where(F.col("column") == c).select(
                F.col("dirty").alias("value"), "canonical"))
    return df


def changed_cells(before: Column, after: Column) -> Column:
    """Aggregate: how many cells a rewrite changes."""
    return F.count_if(~before.eqNullSafe(after))
