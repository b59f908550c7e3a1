"""Segments found by k-means on standardised numeric columns.

All numbers of clusters are tried in the same passes: a pass gives every row to the nearest centre of
each model that still moves, and returns counts and sums per centre. Coordinates are whole numbers
(steps of a standard deviation), so their sums do not depend on the order or the partitions of the
rows, and the same rows get the same labels on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, vocab
from ..functions.cells import without_nan
from ..session import ship_package, written
from .profile import identifier_columns

MIN_ROWS = 20
MAX_K = 6
MIN_SILHOUETTE = 0.15
STEPS = 2 ** 16    # of a standard deviation
MAX_ROUNDS = 20
TOLERANCE = 1e-4   # squared moves of all centres of a model, in variances, at which it is done


def segment_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that vary and are not keys."""
    columns = names.numeric_columns(df, exclude)
    if not columns:
        return []
    row = df.agg(*[(F.min(c) < F.max(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    varying = [c for i, c in enumerate(columns) if row[f"c{i}"]]
    keys = set(identifier_columns(df, varying, vocab.SEGMENT_IDENTIFIER_FRAGMENTS))
    return [c for c in varying if c not in keys]


def _coordinates(rows: DataFrame, features: Sequence[str]) -> Column:
    """Standardised features in whole steps."""
    row = rows.agg(*[f(F.col(c).cast("double")).alias(f"{f.__name__}{i}") for i, c in enumerate(features) for f in (F.avg, F.stddev_samp)]).first()
    steps = []
    for i, c in enumerate(features):
        # six digits: sums of doubles differ in the last ones with the order of rows
        mean, std = (float(f"{row[f'{f}{i}']:.6g}") for f in ("avg", "stddev_samp"))
        steps.append(F.round((F.col(c).cast("double") - mean) / std * STEPS).cast("bigint") if 0 < std < math.inf
                     else F.lit(0).cast("bigint"))
    return F.array(*steps)


def _matrix(points: pa.Array) -> np.ndarray:
    return points.flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1) if len(points) else np.zeros((0, 0), np.int64)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each centre (row) and point (column), added up column by column."""
    columns = [np.ascontiguousarray(x[:, j]) for j in range(x.shape[1])]
    out = np.zeros((len(centres), len(x)))
    for row, centre in zip(out, centres):
        for column, c in zip(columns, centre):
            apart = column - c
            apart *= apart
            row += apart
    return out


def _totals(x: np.ndarray, label: np.ndarray, k: int) -> list[list[int]]:
    """Exact sum of each coordinate per label."""
    if len(x) * float(np.abs(x.astype(float)).max()) < 2.0 ** 53:  # sums of doubles are exact up to there
        return np.stack([np.bincount(label, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1).astype(np.int64).tolist()
    return [[sum(column) for column in x[label == c].T.tolist()] if (label == c).any() else [0] * x.shape[1] for c in range(k)]


def _seeds(rows: DataFrame, wanted: int, seed: int) -> list[list[int]]:
    """Points spread over the data: each next one is drawn with its squared distance to the nearest one so far as weight.

    The draw is a race whose random numbers are hashes of the coordinates.
    """
    start = rows.agg(F.min(F.struct(F.aggregate("point", F.lit(0.0), lambda a, v: a + v.cast("double") * v), "point"))).first()[0]
    chosen = [list(start["point"])]
    while len(chosen) < wanted:
        centres = np.array(chosen, float)

        @F.arrow_udf(T.DoubleType())
        def nearest(points: pa.Array) -> pa.Array:
            return pa.array(_distances(_matrix(points).astype(float), centres).min(axis=0))

        draw = (F.shiftrightunsigned(F.xxhash64("point", F.lit(seed), F.lit(len(chosen))), 11).cast("double") + 0.5) / 2.0 ** 53
        best = (rows.select("point", draw.alias("draw"), nearest("point").alias("far")).where("far > 0")
                .agg(F.max(F.struct((F.log("draw") / F.col("far")).alias("race"), "point"))).first()[0])
        if best is None:  # fewer different points
            break
        chosen.append(list(best["point"]))
    return chosen


def _sums(rows: DataFrame, models: dict[int, np.ndarray]) -> dict[int, dict[int, tuple[int, list[int], float]]]:
    """By model and centre: count, sum of each coordinate, sum of squares of the points nearest to the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            exact, squares = x.astype(float), (x.astype(float) ** 2).sum(axis=1)
            for k, centres in models.items():
                label = _distances(exact, centres).argmin(axis=0)
                count, sums_of = np.bincount(label, minlength=len(centres)), _totals(x, label, len(centres))
                squares_of = np.bincount(label, weights=squares, minlength=len(centres))
                for c in np.flatnonzero(count).tolist():
                    now = total.setdefault((k, c), [0, [0] * x.shape[1], 0.0])
                    now[0] += int(count[c])
                    now[1] = [a + b for a, b in zip(now[1], sums_of[c])]
                    now[2] += float(squares_of[c])
        yield pa.RecordBatch.from_pylist([
            {"k": k, "centre": c, "place": i, "n": n, "total": str(v), "squares": q}
            for (k, c), (n, sums, q) in total.items() for i, v in enumerate(sums)], schema=_PARTIAL)

    found: dict[int, dict[int, tuple[int, list[int], float]]] = {k: {} for k in models}
    parts = rows.select("point").mapInArrow(run, "k int, centre int, place int, n bigint, total string, squares double")
    # one row per model, centre and column
    for row in parts.groupBy("k", "centre", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
                                                         F.sum("squares").alias("squares")).orderBy("k", "centre", "place").collect():
        n, sums, q = found[row["k"]].setdefault(row["centre"], (row["n"], [], row["squares"]))
        sums.append(int(row["total"]))
    return found


_PARTIAL = pa.schema([("k", pa.int32()), ("centre", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.string()),
                      ("squares", pa.float64())])


def _fitted(rows: DataFrame, seeds: list[list[int]], ks: Sequence[int]) -> tuple[dict, dict]:
    """Centres of each k, and the sums of their clusters."""
    centres = {k: np.array(seeds[:k], float) for k in ks}
    sums: dict = {}
    moving = set(ks)
    for _ in range(MAX_ROUNDS):
        now = _sums(rows, {k: centres[k] for k in moving})
        sums.update(now)
        for k in sorted(moving):
            new = centres[k].copy()
            for c, (n, total, _) in now[k].items():  # a centre without points stays
                new[c] = [float(Fraction(v, n)) for v in total]
            if ((new - centres[k]) ** 2).sum() <= TOLERANCE * STEPS ** 2:
                moving.discard(k)  # the centres that its sums belong to stay
            else:
                centres[k] = new
        if not moving:
            break
    if moving:
        sums.update(_sums(rows, {k: centres[k] for k in moving}))
    return centres, sums


def _silhouettes(rows: DataFrame, centres: dict, sums: dict, n: int) -> dict[int, float]:
    """Mean silhouette of each k by squared distances, from the sums of its clusters; all in one pass."""
    parts = {}
    for k, found in sums.items():
        held = sorted(found)
        parts[k] = (centres[k], {c: i for i, c in enumerate(held)}, np.array([found[c][0] for c in held], float),
                    np.array([found[c][1] for c in held], float), np.array([found[c][2] for c in held]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(parts, 0.0)
        for batch in batches:
            x = _matrix(batch.column(0)).astype(float)
            if not len(x):
                continue
            squares = (x ** 2).sum(axis=1)
            for k, (own_centres, place, count, sums_of, squares_of) in parts.items():
                label = _distances(x, own_centres).argmin(axis=0)
                at = np.array([place.get(c, 0) for c in range(len(own_centres))])[label]
                apart = np.maximum(count * squares[:, None] - 2 * x @ sums_of.T + squares_of, 0)
                every = np.arange(len(x))
                alone = count[at] == 1
                inside = apart[every, at] / np.where(alone, 1, count[at] - 1)
                others = apart / count
                others[every, at] = np.inf
                outside = others.min(axis=1)
                largest = np.maximum(inside, outside)
                total[k] += float(np.where(alone | (largest == 0), 0.0, (outside - inside) / np.where(largest == 0, 1, largest)).sum())
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(total), pa.int32()), "score": pa.array(list(total.values()), pa.float64())})

    found = rows.select("point").mapInArrow(run, "k int, score double").groupBy("k").agg(F.sum("score").alias("score")).collect()
    return {row["k"]: round(row["score"] / n, 9) for row in found}


def label_rows(df: DataFrame, row_id: str, exclude: Sequence[str] = (),
               min_silhouette: float = MIN_SILHOUETTE, seed: int = 42) \
        -> tuple[DataFrame, dict] | None:
    """(rows with their cluster, facts about the choice), or None without real structure.

    Rows with a null id or feature take no part. Of equal silhouettes (squared Euclidean) the smallest
    k is taken. Clusters are numbered by size, the largest first, then by centre.
    """
    ship_package(df.sparkSession)
    df = without_nan(df)
    features = segment_features(df, [*exclude, row_id])
    if len(features) < 2:
        return None
    complete = df.select(row_id, *features).na.drop()
    n = complete.count()
    if n < MIN_ROWS:
        return None
    rows = written(complete.select(F.struct(row_id, *features).alias("row"), _coordinates(complete, features).alias("point")))
    ks = range(2, max(3, min(MAX_K, n // 10) + 1))
    seeds = _seeds(rows, ks[-1], seed)
    centres, sums = _fitted(rows, seeds, [k for k in ks if k <= len(seeds)])
    sums = {k: found for k, found in sums.items() if len(found) > 1}
    scores = _silhouettes(rows, centres, sums, n) if sums else {}
    if not scores or max(scores.values()) < min_silhouette:
        return None
    k = min(scores, key=lambda k: (-scores[k], k))
    order = sorted(range(k), key=lambda c: (-sums[k].get(c, (0,))[0], centres[k][c].tolist()))
    number = np.argsort(order).astype(np.int32)
    own = centres[k]

    @F.arrow_udf(T.IntegerType())
    def cluster(points: pa.Array) -> pa.Array:
        return pa.array(number[_distances(_matrix(points).astype(float), own).argmin(axis=0)], pa.int32())

    facts = {"k": k, "silhouette": round(scores[k], 3), "metric": "squaredEuclidean",
             "features": features, "rows": n}
    return rows.select("row.*", cluster("point").alias("cluster")), facts


def segments(df: DataFrame, row_id: str, exclude: Sequence[str] = (),
             min_silhouette: float = MIN_SILHOUETTE) -> DataFrame:
    """Size, share and mean of each feature per cluster; no rows without real structure."""
    found = label_rows(df, row_id, exclude, min_silhouette)
    if found is None:
        return df.sparkSession.createDataFrame(
            [], "cluster int, size bigint, pct_of_total double, k int, silhouette double")
    rows, facts = found
    return rows.groupBy("cluster").agg(
        F.count("*").alias("size"),
        F.round(F.count("*") * 100.0 / facts["rows"], 1).alias("pct_of_total"),
        *[F.round(F.avg(c), 2).alias(c) for c in facts["features"]]).select(
        "*", F.lit(facts["k"]).alias("k"), F.lit(facts["silhouette"]).alias("silhouette"))
