"""Date text: content tests, the format ladder and month-year spellings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import vocab
from .cells import plain_number, trimmed
from .counts import cells_where, value_counts
from .names import has_word

_PAIR = r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2,4})$"


def name_suggests_date(name: str) -> bool:
    return not has_word(name, vocab.DURATION_WORDS) and has_word(name, vocab.DATE_WORDS)


def name_is_duration(name: str) -> bool:
    return has_word(name, vocab.DURATION_WORDS)


def ladder(day_first: bool) -> tuple[str, ...]:
    """Formats in the order they are tried."""
    return ((vocab.DAY_FIRST_FORMATS if day_first else vocab.MONTH_FIRST_FORMATS)
            + vocab.GENERAL_FORMATS)


def wider(day_first: bool) -> tuple[str, ...]:
    """Further spellings, tried only if the ladder does not read a column."""
    first, second = ((vocab.WIDER_DAY_FIRST, vocab.WIDER_MONTH_FIRST) if day_first
                     else (vocab.WIDER_MONTH_FIRST, vocab.WIDER_DAY_FIRST))
    return vocab.WIDER_FORMATS + first + second


def _two_digit_year(stamp: Column) -> Column:
    """yy is read as 20yy; from the pivot on it means 19yy."""
    late = F.year(stamp) >= 2000 + vocab.TWO_DIGIT_YEAR_PIVOT
    return F.when(late, F.add_months(stamp, -1200).cast("timestamp")).otherwise(stamp)


def _shape(fmt: str) -> str:
    """Regular expression for text the format could read, so misfits never reach the parser."""
    widths = {"yyyy": "[0-9]{4}", "yy": "[0-9]{2}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}",
              "M": "[0-9]{1,2}", "MM": "[0-9]{2}", "d": "[0-9]{1,2}", "dd": "[0-9]{2}",
              "H": "[0-9]{1,2}", "h": "[0-9]{1,2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}",
              "SSSSSS": "[0-9]{1,6}", "a": "[AaPp][Mm]", "XXX": "(?:Z|[+-][0-9]{2}:[0-9]{2})", "'T'": "T"}
    body = re.sub(r"'T'|([A-Za-z])\1*|\.", lambda m: widths.get(m.group(0), r"\."), fmt)
    return f"^{body}$"


def parse_with(c: Column, fmt: str) -> Column:
    """Timestamp under one format, null where the text does not fit it."""
    text = trimmed(c)
    if fmt == "unix":
        return F.timestamp_seconds(F.when(_is_unix(c), plain_number(text)))
    fitting = F.when(text.rlike(_shape(fmt)), F.upper(text) if fmt.endswith(" a") else text)
    stamp = F.try_to_timestamp(fitting, F.lit(fmt.replace("SSSSSS", "[SSSSSS][SSSSS][SSSS][SSS][SS][S]")
                                              if "XXX" in fmt or "'T'" in fmt else fmt))
    return _two_digit_year(stamp) if fmt.endswith("yy") and not fmt.endswith("yyyy") else stamp


def _is_unix(c: Column) -> Column:
    low, high = vocab.UNIX_SECONDS_RANGE
    number = plain_number(trimmed(c))
    return (number > low) & (number < high)


def parse_date(c: Column, formats: tuple[str, ...]) -> Column:
    """Calendar date from the first format that fits the cell."""
    return F.coalesce(*[parse_with(c, f) for f in formats]).cast("date")


def parse_month_year(c: Column) -> Column:
    """First of the month for spellings such as Jan-2024, 2024 Jan, 03/2024 or Jan 24."""
    spellings = tuple(f for f in vocab.GENERAL_FORMATS if "d" not in f) + vocab.MONTH_YEAR_FORMATS
    return parse_date(c, spellings)


@dataclass(frozen=True)
class DateFit:
    """What the contents of one text column say about it being dates."""

    column: str
    n_values: int
    bare_share: float
    signal_share: float
    month_name_rows: int
    leading_date_rows: int
    day_first: bool
    unix_share: float
    format_shares: dict[str, float]
    mixed_share: float
    wider: tuple[str, ...] | None = None

    @property
    def looks_like_dates(self) -> bool:
        return (self.bare_share < vocab.BARE_NUMBER_SHARE
                and self.signal_share >= vocab.DATE_SIGNAL_SHARE)

    @property
    def is_candidate(self) -> bool:
        by_month = self.month_name_rows >= min(3, self.n_values // 2 + 1)
        return not name_is_duration(self.column) and (
            name_suggests_date(self.column) or by_month or self.leading_date_rows >= 3)

    def formats(self) -> tuple[str, ...] | None:
        """Formats to apply, or None if the column is not dates."""
        if self.unix_share >= vocab.UNIX_SECONDS_SHARE:
            return ("unix",)
        if not self.looks_like_dates:
            return None
        order = ladder(self.day_first)
        for fmt in order:
            if self.format_shares[fmt] >= vocab.DATE_PARSE_SHARE:
                return (fmt,)
        if self.mixed_share >= vocab.DATE_PARSE_SHARE:
            return order + vocab.MONTH_YEAR_FORMATS
        return self.wider


def _vote(text: Column, first_over: bool) -> Column:
    a = F.regexp_extract(text, _PAIR, 1).try_cast("int")
    b = F.regexp_extract(text, _PAIR, 2).try_cast("int")
    return cells_where((a > 12) & (b <= 12)) if first_over else cells_where((b > 12) & (a <= 12))


def shape_evidence(c: Column) -> list[Column]:
    """The cheap part of the evidence: pattern counts, no parsing."""
    text = trimmed(c)
    return [F.sum("count").alias("n"),
            cells_where(text.rlike(vocab.BARE_NUMBER_PATTERN)).alias("bare"),
            cells_where(text.rlike(vocab.DATE_SIGNAL_PATTERN)).alias("signal"),
            cells_where(text.rlike(vocab.MONTH_NAME_PATTERN)).alias("month_names"),
            cells_where(text.rlike(vocab.LEADING_DATE_PATTERN)).alias("leading")]


def may_be_dates(column: str, counts) -> bool:
    """Whether trying the formats on a column is worth a pass, from its shape evidence."""
    n = counts["n"]
    if not n or counts["bare"] / n >= vocab.BARE_NUMBER_SHARE \
            or counts["signal"] / n < vocab.DATE_SIGNAL_SHARE:
        return False
    return (name_suggests_date(column) or counts["month_names"] >= min(3, n // 2 + 1)
            or counts["leading"] >= 3)


def fitting_formats(counts: DataFrame) -> dict[str, tuple[str, ...]]:
    """The formats whose shape some cell of each column has; no other one can read a cell.

    Shapes do not tell digits apart, so they are tried on the distinct outlines of the cells, in which
    every digit is a zero.
    """
    every = tuple(dict.fromkeys(f for first in (True, False)
                                for f in ladder(first) + wider(first) + vocab.MONTH_YEAR_FORMATS))
    outlines = counts.select("column", F.translate(trimmed(F.col("value")), "123456789", "0" * 9).alias("outline")).distinct()
    rows = outlines.groupBy("column").agg(*[F.bool_or(F.col("outline").rlike(_shape(f))).alias(f"f{i}")
                                            for i, f in enumerate(every)]).collect()  # one row per column
    return {r["column"]: tuple(f for i, f in enumerate(every) if r[f"f{i}"]) for r in rows}


def _reads(formats: tuple[str, ...]) -> Column:
    """Aggregate: cells that any of the formats reads."""
    return cells_where(parse_date(F.col("value"), formats).isNotNull()) if formats else F.lit(0).cast("bigint")


def fit_dates(df: DataFrame, columns: list[str]) -> dict[str, DateFit]:
    """Judge each text column over all its rows, no sampling."""
    return fit_counts(written(value_counts(df, columns)), columns) if columns else {}


def fit_counts(counts: DataFrame, columns: list[str]) -> dict[str, DateFit]:
    """Judge text columns from the counts of their distinct values, each of which is parsed once.

    One aggregate finds the formats that can fit at all; then one per column, and a second one, for mixed
    and for further spellings, only if no single format fits.
    """
    every = tuple(dict.fromkeys(ladder(True) + ladder(False)))
    fitting = fitting_formats(counts.where(F.col("column").isin(list(columns))))
    fits = {}
    for column in columns:
        own, value = counts.where(F.col("column") == column), F.col("value")
        found = fitting.get(column, ())
        tried = tuple(f for f in every if f in found)
        row = own.agg(*shape_evidence(value), _vote(trimmed(value), True).alias("day_votes"),
                      _vote(trimmed(value), False).alias("month_votes"), cells_where(_is_unix(value)).alias("unix"),
                      *[_reads((f,)).alias(f"hits_{i}") for i, f in enumerate(tried)]).first()
        n = row["n"] or 0
        share = (lambda hits, n=n: hits / n if n else 0.0)
        day_first = row["day_votes"] > row["month_votes"]
        shares = dict.fromkeys(every, 0.0) | {f: share(row[f"hits_{i}"]) for i, f in enumerate(tried)}
        more = None
        mixed = max(shares[f] for f in ladder(day_first))
        if mixed < vocab.DATE_PARSE_SHARE:
            order = ladder(day_first) + vocab.MONTH_YEAR_FORMATS
            widest = ladder(day_first) + wider(day_first) + vocab.MONTH_YEAR_FORMATS
            further = tuple(f for f in wider(day_first) if f in found)
            hits = own.agg(_reads(tuple(f for f in order if f in found)), _reads(tuple(f for f in widest if f in found)),
                           *[_reads((f,)) for f in further]).first()
            mixed = share(hits[0])
            if mixed < vocab.DATE_PARSE_SHARE and row["bare"] < vocab.BARE_NUMBER_SHARE * max(n, 1):
                alone = next((f for f, h in zip(further, hits[2:]) if h >= vocab.DATE_PARSE_SHARE * n), None)
                more = (alone,) if alone else widest if share(hits[1]) >= vocab.DATE_PARSE_SHARE else None
        fits[column] = DateFit(
            column=column,
            n_values=n,
            bare_share=share(row["bare"]),
            signal_share=share(row["signal"]),
            month_name_rows=row["month_names"],
            leading_date_rows=row["leading"],
            day_first=day_first,
            unix_share=share(row["unix"]),
            format_shares=shares,
            mixed_share=mixed,
            wider=more,
        )
    return fits
