"""Edit distance between long texts, where the built-in one would take quadratic time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _shared_length(a: str, b: str, i: int, j: int) -> int:
    """Length of the common run of a[i:] and b[j:], by doubling and halving slice compares."""
    limit = min(len(a) - i, len(b) - j)
    done, step = 0, 1
    while done < limit:
        step = min(step, limit - done)
        if a[i + done:i + done + step] == b[j + done:j + done + step]:
            done, step = done + step, step * 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return done


def _within(a: str, b: str, limit: int) -> int:
    """Edits from a to b if at most ``limit``, else -1 (Landau and Vishkin, 1989)."""
    goal = len(b) - len(a)
    if abs(goal) > limit:
        return -1
    reach = {0: _shared_length(a, b, 0, 0)}  # diagonal -> furthest place in a with e edits
    for edits in range(limit + 1):
        if reach.get(goal, -1) >= len(a):
            return edits
        further = {}
        for k in range(-edits - 1, edits + 2):
            starts = [reach[k] + 1] if k in reach else []
            starts += [reach[k + 1] + 1] if k + 1 in reach else []
            starts += [reach[k - 1]] if k - 1 in reach else []
            place = min(max(starts), len(a)) if starts else -1
            if 0 <= place + k <= len(b):
                further[k] = place + _shared_length(a, b, place, place + k)
        reach = further
    return -1


def long_edit_distance(a: Column, b: Column, limit: int) -> Column:
    """Bounded edit distance over Arrow batches, linear in text length for a small limit; null for nulls."""

    @F.pandas_udf(T.IntegerType())
    def measure(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _within(x, y, limit)
                          for x, y in zip(left, right)], dtype="Int32")

    return measure(a, b)
