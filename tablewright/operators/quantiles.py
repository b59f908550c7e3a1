"""Exact percentiles with linear interpolation, for columns of any size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, copysign, floor, isinf, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spark's exact percentile keeps every distinct value of a column in one task.
BUILT_IN_ROWS = 20_000
BINS = 4096
# Items kept by a sketch, and the share of ranks by which a bracket goes beyond the wanted one:
# about four times the error that a sketch of this size has in 99 of 100 cases.
SKETCH_ITEMS = 4000
MARGIN = 0.003


@dataclass
class _Range:
    """Values between low and high of one column, holding the wanted ranks."""

    column: int
    low: float
    high: float
    below: int
    rows: int
    ranks: list[int]

    @property
    def spread(self) -> bool:
        """Whether equal widths would take many passes: infinite, or over many magnitudes."""
        return isinf(self.low) or isinf(self.high) or abs(_steps(self.high) - _steps(self.low)) > 20


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    built_in_rows: int = BUILT_IN_ROWS, bins: int = BINS,
                    n_rows: int | None = None, margin: float = MARGIN) -> dict[str, list[float | None]]:
    """Percentiles of each numeric column over its non-null values.

    Above ``built_in_rows``, one aggregate takes a quantile sketch of every column, which brackets
    each wanted rank between two values; a second counts the rows below and up to these, which
    proves the brackets. Then only the rows inside a bracket (some thousandths of all) are counted by bins, in
    equal widths or, over many magnitudes, by sign and magnitude, until a bin is a single value. A
    bracket that misses its rank is given up for the whole column, so results are exact whatever the sketch
    says. Every pass is one aggregate with partial sums and at most ``bins`` rows per range.
    """
    if not columns:
        return {}
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows <= built_in_rows:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        row = df.agg(*[F.percentile(c, probs).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probabilities))
                for i, c in enumerate(columns)}

    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    edges = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probabilities for d in (-margin, margin)])
    heads = values.agg(*[
        F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"),
                 F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(v, SKETCH_ITEMS), edges).alias("at")).alias(v)
        for v in values.columns]).first()
    places = {i: [p * (heads[i]["n"] - 1) for p in probabilities] for i in range(len(columns))}
    found: dict[tuple[int, int], float] = {}
    ranges = _bracketed(values, heads, places, probabilities, margin, found)
    while ranges:
        ranges = _narrow(values, ranges, found, bins)
    return {c: [None if not heads[i]["n"] else _between(found[i, floor(at)], found[i, ceil(at)],
                                                        at - floor(at))
                for at in places[i]] for i, c in enumerate(columns)}


def _bracketed(values: DataFrame, heads, places: dict, probabilities: Sequence[float], margin: float,
               found: dict) -> list[_Range]:
    """Ranges that are sure to hold the wanted ranks; ranks of brackets with one value are found."""
    brackets: dict[tuple[int, float, float], set[int]] = {}
    for i, at in places.items():
        head = heads[i]
        for j, (p, place) in enumerate(zip(probabilities, at if head["n"] else [])):
            low = head["low"] if p <= margin else head["at"][2 * j]
            high = head["high"] if p >= 1 - margin else head["at"][2 * j + 1]
            brackets.setdefault((i, low, high), set()).update((floor(place), ceil(place)))
    if not brackets:
        return []
    counts = values.agg(*[
        F.struct(F.count_if(F.col(f"v{i}") < low).alias("below"), F.count_if(F.col(f"v{i}") <= high).alias("upto")).alias(f"b{b}")
        for b, (i, low, high) in enumerate(brackets)]).first()
    ranges, missed = [], {}
    for b, ((i, low, high), ranks) in enumerate(brackets.items()):
        below, upto = counts[b]
        inside = {k for k in ranks if below <= k < upto}
        missed.setdefault(i, set()).update(ranks - inside)
        if low == high:
            found.update({(i, k): low for k in inside})
        elif inside:
            ranges.append(_Range(i, low, high, below, upto - below, sorted(inside)))
    return ranges + [_Range(i, heads[i]["low"], heads[i]["high"], 0, heads[i]["n"], sorted(ranks))
                     for i, ranks in missed.items() if ranks]


def _steps(v: float) -> float:
    """The step function of ``_magnitude`` for one finite or infinite value."""
    if v == 0 or isinf(v):
        return copysign(1000, v) if v else 0
    return copysign(floor(log2(abs(v)) / 4) + 300, v)


def _between(low: float, high: float, share: float) -> float:
    return low if low == high or not share else low + share * (high - low)


def _magnitude(v: Column) -> Column:
    """A step function that never falls: sign and power of two, zero and infinities by themselves."""
    power = F.floor(F.log2(F.abs(v)) / 4) + 300
    return F.when(v == 0, 0).when(F.abs(v) == float("inf"), F.signum(v) * 1000).otherwise(F.signum(v) * power)


def _narrow(values: DataFrame, ranges: list[_Range], found: dict, bins: int) -> list[_Range]:
    """One counting pass over all ranges; returns the smaller ranges still to search."""
    entries, touched = [], F.lit(False)
    for number, r in enumerate(ranges):
        v = F.col(f"v{r.column}")
        inside = v.between(r.low, r.high)
        touched = touched | inside
        width = r.high / bins - r.low / bins
        # few rows, or bins that no longer split neighbouring doubles: every value is a bin
        single = r.rows <= bins or r.low + width <= r.low
        slot = v if single else _magnitude(v) if r.spread else F.least(F.floor((v - r.low) / width), F.lit(bins - 1))
        entries.append(F.struct(F.lit(number).alias("range"), F.when(
            inside, slot.cast("double")).alias("slot"), v.alias("v")))
    counted = (values.where(touched).select(F.inline(F.array(*entries))).where("slot IS NOT NULL")
               .groupBy("range", "slot")
               .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
               .orderBy("range", "slot").collect())
    smaller, seen = [], {}
    for b in counted:
        r = ranges[b["range"]]
        below = seen.get(b["range"], r.below)
        seen[b["range"]] = below + b["n"]
        wanted = [k for k in r.ranks if below <= k < below + b["n"]]
        if wanted and b["low"] == b["high"]:
            found.update({(r.column, k): b["low"] for k in wanted})
        elif wanted:
            smaller.append(_Range(r.column, b["low"], b["high"], below, b["n"], wanted))
    return smaller
