"""Cell-level rewrites as built-in column expressions, usable in any select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab

_SPACES = ("\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f \x85\xa0\u1680"
           + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000")
_NUMBER = r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?"
_SCALED = r"-?[0-9]+\.?[0-9]*[kKmMbB]"


def trimmed(c: Column) -> Column:
    """Strip every kind of white space, not only the plain space."""
    return F.btrim(c, F.lit(_SPACES))


def is_null_marker(c: Column) -> Column:
    return F.lower(trimmed(c)).isin(*vocab.NULL_MARKERS)


def sweep_nulls(c: Column) -> Column:
    """Null for any spelling of "no value", the cell unchanged otherwise."""
    return F.when(~is_null_marker(c), c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def plain_number(c: Column) -> Column:
    """Text to double, refusing forms such as ``1d``, ``NaN`` or hex that a bare cast takes."""
    return F.when(c.rlike(f"^{_NUMBER}$"), c.try_cast("double"))


def parse_number(c: Column) -> Column:
    """Messy numeric text to double; whatever is not a number becomes null.

    Null markers need no test of their own, since none of them reads as a number.
    """
    signed = F.regexp_replace(trimmed(c), r"^\((.*)\)$", "-$1")
    bare = F.regexp_replace(F.regexp_replace(signed, rf"(?U)[{vocab.CURRENCY_SIGNS},%\s]", ""),
                            r"^\+", "")
    thousands = F.instr(F.lit("kmb"), F.lower(F.right(bare, F.lit(1))))  # 0 without a unit
    amount = F.regexp_replace(bare, "[kKmMbB]$", "").try_cast("double")
    fits = bare.rlike(f"^({_SCALED}|{_NUMBER})$")
    # plain words, the usual case in text columns, are settled by the first test alone
    return F.when(c.rlike("[0-9]") & fits, amount * F.pow(F.lit(1000.0), thousands))


def has_currency_sign(c: Column) -> Column:
    return c.rlike(f"[{vocab.CURRENCY_SIGNS}]")


def loose_number(c: Column) -> Column:
    """Chart-side coercion: keep digits, point and minus only."""
    return plain_number(F.regexp_replace(c.cast("string"), r"[^0-9.\-]", ""))


def clean_text(c: Column) -> Column:
    """Plain words: typographic marks, controls and special characters become spaces."""
    plain = F.translate(c, vocab.SPACED_CHARACTERS + vocab.DROPPED_CHARACTERS,
                        " " * len(vocab.SPACED_CHARACTERS))
    plain = F.regexp_replace(plain, vocab.CONTROL_PATTERN, "")
    plain = F.regexp_replace(plain, vocab.SPECIAL_PATTERN, " ")
    return F.nullif(trimmed(F.regexp_replace(plain, r"(?U)\s+", " ")), F.lit(""))


def is_boolean_word(c: Column) -> Column:
    return F.lower(trimmed(c)).isin(*vocab.TRUE_WORDS, *vocab.FALSE_WORDS)


def yes_no(c: Column) -> Column:
    word = F.lower(trimmed(c))
    return (F.when(word.isin(*vocab.TRUE_WORDS), "Yes")
            .when(word.isin(*vocab.FALSE_WORDS), "No").otherwise(c))


def digits_only(c: Column) -> Column:
    """Null for an identifier holding anything but digits."""
    return F.when(~c.rlike("[^0-9]"), c)


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """Limit to [low, high]; nulls stay null, unlike with bare greatest/least."""
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(c.isNotNull(), bounded)


def is_title_case(c: Column) -> Column:
    """Well-formed category text: title case, trimmed, single-spaced."""
    return (c == F.initcap(c)) & (c == trimmed(c)) & ~c.rlike(r"(?U)\s{2,}")


def format_value(c: Column, prefix: str = "") -> Column:
    """Display form: billions, millions, thousands with one digit, else two digits."""
    size = F.abs(c)
    shown = (F.when(size >= 1e9, F.concat(F.format_number(c / 1e9, 2), F.lit("B")))
             .when(size >= 1e6, F.concat(F.format_number(c / 1e6, 2), F.lit("M")))
             .when(size >= 1e3, F.format_number(c, 1))
             .otherwise(F.format_number(c, 2)))
    return F.when(c.isNull(), "N/A").otherwise(F.concat(F.lit(prefix), shown))


def normalise_ascii(c: Column) -> Column:
    """Comparison form of text that carries no accents: words in lower case, single-spaced."""
    spaced = F.regexp_replace(c, r"(?U)[^\w\s]", " ")
    return F.lower(trimmed(F.regexp_replace(spaced, r"(?U)\s+", " ")))


def without_nan(df: DataFrame) -> DataFrame:
    """Not-a-number counts as missing everywhere; map it to null once, at the start."""
    floats = {f.name: nan_to_null(F.col(f.name)) for f in df.schema
              if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(floats) if floats else df
