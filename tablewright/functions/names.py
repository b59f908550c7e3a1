"""Rules that look only at column names, so they cost no pass over the data."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vocab

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def has_word(name: str, words: Iterable[str]) -> bool:
    """True if a word stands in the name with no letter or digit glued to it."""
    alternatives = "|".join(re.escape(w) for w in words)
    return re.search(rf"(?<![a-z0-9])(?:{alternatives})(?![a-z0-9])", name.lower()) is not None


def has_fragment(name: str, fragments: Iterable[str]) -> bool:
    """True if any fragment occurs anywhere in the name."""
    lowered = name.lower()
    return any(f in lowered for f in fragments)


def standard_names(names: Sequence[str]) -> list[str]:
    """Snake-case names; empty or repeated results get a numeric suffix."""
    taken: set[str] = set()
    result = []
    for name in names:
        base = re.sub(r"[^a-z0-9_]", "", re.sub(r"\s+", "_", name.strip().lower())) or "column"
        candidate, suffix = base, 2
        while candidate in taken:
            candidate, suffix = f"{base}_{suffix}", suffix + 1
        taken.add(candidate)
        result.append(candidate)
    return result


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, _NUMERIC) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.StringType) and f.name not in skip]


def date_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, _TEMPORAL) and f.name not in skip]


def business_columns(names: Iterable[str]) -> list[str]:
    """Drop derived date parts and structural metadata, which are never chart axes."""
    return [n for n in names
            if not n.lower().endswith(vocab.DERIVED_SUFFIXES)
            and not has_fragment(n, vocab.STRUCTURAL_FRAGMENTS)]


def business_label(name: str, extra: Sequence[tuple[Sequence[str], str, str]] = ()) \
        -> tuple[str, str]:
    """(label, value prefix) of the most specific keyword found in the name."""
    lowered = name.lower()
    matches = [
        ((max(len(k) for k in hits), bool(prefix), -position), (label, prefix))
        for position, (words, label, prefix) in enumerate((*vocab.BUSINESS_LABELS, *extra))
        if (hits := [k for k in words if k in lowered])
    ]
    if not matches:
        return name.replace("_", " ").replace("-", " ").title(), ""
    return max(matches)[1]


def is_revenue_name(name: str) -> bool:
    """Whole-token test, so a unit price is never taken for revenue."""
    tokens = set(re.split(r"[_\s\-]+", name.lower()))
    if tokens & set(vocab.UNIT_TOKENS):
        return False
    return bool(tokens & set(vocab.REVENUE_TOKENS)
                or (tokens & set(vocab.TOTAL_TOKENS) and tokens & set(vocab.MONEY_TOKENS)))


def is_key_name(name: str) -> bool:
    """Names that end like a key (custkey, customer_id, zip_code): numbers that say which, not how much."""
    last = re.split(r"[^A-Za-z0-9]+", name.strip())[-1]
    return last.lower().endswith("key") or last.endswith(("Id", "ID")) or last.lower() in vocab.KEY_ENDINGS


def status_column(df: DataFrame) -> str | None:
    """First text column whose name mentions a status."""
    return next((c for c in text_columns(df) if has_fragment(c, vocab.STATUS_FRAGMENTS)), None)


def money_column(df: DataFrame) -> str | None:
    """First numeric column named like money, one naming a final or total amount first."""
    money = [c for c in numeric_columns(df) if has_fragment(c, vocab.MONEY_FRAGMENTS)]
    settled = [c for c in money if has_fragment(c, ("final", "total"))]
    return next(iter(settled or money), None)


def bound_rule(name: str) -> str | None:
    """Which domain bound a numeric column's name implies."""
    if has_word(name, vocab.RATING_WORDS):
        return "rating"
    if has_word(name, vocab.PERCENT_WORDS):
        return "percent"
    if has_word(name, vocab.SIGNED_WORDS):
        return "signed"
    if has_word(name, vocab.NON_NEGATIVE_WORDS):
        return "non_negative"
    return None


def floor_at_zero(name: str) -> bool:
    """Columns whose outlier floor may not fall below zero."""
    if has_word(name, vocab.SIGNED_WORDS):
        return False
    return has_word(name, (*vocab.NON_NEGATIVE_WORDS, *vocab.RATING_WORDS, *vocab.PERCENT_WORDS))


def is_digit_identifier(name: str) -> bool:
    """Identifiers that may hold digits only (accounts, phones, zips), by whole words."""
    return (has_word(name, (*vocab.DIGIT_ID_FRAGMENTS, *vocab.ID_FRAGMENTS))
            and not has_word(name, (*vocab.LETTERED_ID_FRAGMENTS, *vocab.MONEY_TOKENS,
                                    *vocab.SIGNED_WORDS)))


def is_identifier_role(name: str) -> bool:
    lowered = name.lower()
    return lowered.endswith("_id") or lowered == "id" or has_fragment(name, vocab.ID_FRAGMENTS)
