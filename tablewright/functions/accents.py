"""The one Arrow function: Unicode decomposition, which Spark SQL does not offer."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import normalise_ascii


def _decomposed(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return "".join(ch for ch in unicodedata.normalize("NFKD", text)
                   if not unicodedata.combining(ch))


@F.pandas_udf(T.StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, whole Arrow batches at a time."""
    return texts.map(_decomposed)


def normalise_text(c: Column) -> Column:
    """Comparison form: accents and punctuation removed, lower case, single-spaced."""
    return normalise_ascii(strip_accents(c))
