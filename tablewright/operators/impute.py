"""Filling missing cells: median, mode, neighbouring dates, or a forest per column."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, vocab
from ..functions.cells import without_nan
from ..session import spread, written
from .profile import missing_profile, top_values, value_counts
from .quantiles import exact_quantiles
from .ranking import carry_fill, global_index

MAX_CLASSES = 100  # classes of one forest; more labels are voted on in steps
MAX_BINS = 64       # of a number, as seen by a forest
WHOLE_ROWS = 10_000  # up to here Spark itself finds the bounds of bins in all rows
MOST_BINS = 46_340  # the largest number whose square Spark can hold
LEAST_SLICES = 4    # weighted rows that a feature vector is kept as


def fill_values(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, object]:
    """Median of numeric columns; most frequent value of text columns, the smallest on a tie."""
    df = without_nan(df)
    columns = set(columns if columns is not None else df.columns)
    numeric = [c for c in names.numeric_columns(df) if c in columns]
    text = [c for c in names.text_columns(df) if c in columns]
    values: dict[str, object] = {c: q[0] for c, q in exact_quantiles(df, numeric, [0.5]).items()}
    if text:
        modes = top_values(value_counts(df, text), 1).collect()  # one row per column
        values |= dict.fromkeys(text, vocab.FILL_TEXT) | {r["column"]: r["value"] for r in modes}
    return {c: v for c, v in values.items() if v is not None}


def fill_with(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill nulls; a whole-number column with a fractional fill value widens to double."""
    types = dict(df.dtypes)
    filled = {}
    for c, v in values.items():
        if c not in types:
            continue
        whole = not isinstance(v, float) or v.is_integer()
        filled[c] = F.coalesce(F.col(c), F.lit(v).cast(types[c] if whole else "double"))
    return without_nan(df).withColumns(filled) if filled else df


def fill_simple(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Median or mode everywhere; with an order key, dates from their neighbours."""
    missing = [r["column"] for r in missing_profile(df).where("missing > 0").collect()]
    filled = fill_with(df, fill_values(df, missing))
    return fill_dates(filled, order) if order else filled


def fill_dates(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each missing date from the row before it in order, else from the row after."""
    columns = [c for c in names.date_columns(df) if c not in order]
    return carry_fill(df, columns, order) if columns else df


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code) with codes in sorted order of the distinct values, however many."""
    distinct = df.select(F.col(column).cast("string").alias("value")).na.drop().distinct()
    return global_index(written(distinct), ["value"], "code")


@dataclass(frozen=True)
class ForestOptions:
    trees: int = vocab.FOREST_TREES
    trees_wide: int = vocab.FOREST_TREES_WIDE
    depth: int = vocab.FOREST_DEPTH
    seed: int = 42
    merge_rows: int = 200_000  # beyond, rows of equal binned features (and label) are merged


def forest_impute(df: DataFrame, row_id: str, options: ForestOptions = ForestOptions(),
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Predict missing cells of each column from all other columns with a random forest.

    Columns over 70% missing, without usable features or with fewer than five known cells get
    the simple fill, as do dates (from neighbouring rows). Text and columns of at most ten
    distinct numbers are classified, others regressed. Any number of labels is predicted, see
    `_vote`. Every forest learns from all rows with a known cell, see `_learned`; prediction covers
    every row with a missing cell.
    """
    whole = df.columns
    df = spread(without_nan(df).drop(*[c for c, kind in df.dtypes if kind == "void"]))  # cells without a type are not files
    n_rows = df.count()
    missing = {r["column"]: r["missing"] for r in missing_profile(df).collect()}
    wanted = [c for c in (columns or df.columns) if missing.get(c, 0) > 0 and c != row_id]
    dates = [c for c in wanted if c in names.date_columns(df)]
    encoded = _encoded(df, row_id, [c for c in df.columns if c != row_id])
    simple, predicted = [], {}
    for c in wanted:
        if c in dates:
            continue
        features = [f for f in df.columns if f not in (c, row_id)
                    and missing[f] / n_rows < vocab.IMPUTE_FEATURE_MAX_MISSING]
        pct, known = missing[c] * 100.0 / n_rows, n_rows - missing[c]
        forest = None
        if pct <= vocab.IMPUTE_MAX_MISSING_PCT and features and known >= vocab.IMPUTE_MIN_KNOWN:
            trees = (options.trees if len(predicted) < vocab.FOREST_WIDE_AFTER
                     else options.trees_wide)
            forest = _forest(df, encoded, row_id, c, features, known, trees, options)
        if forest is None:
            simple.append(c)
        else:
            predicted[c] = forest
    result = encoded
    for c, forest in predicted.items():
        result = forest(result, f"p_{c}")
    kinds = dict(df.dtypes)
    result = result.select(*[
        F.lit(None).alias(c) if c not in kinds else F.col(f"_row.`{c}`") if c not in predicted
        else F.coalesce(F.col(f"_row.`{c}`"), F.col(f"`p_{c}`").cast(kinds[c])).alias(c) for c in whole])
    if simple:
        result = fill_with(result, fill_values(df, simple))
    return fill_dates(result, [row_id]) if dates else result


def _encoded(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Every column as a number (f_name) with a missing flag (m_name), -1 for missing, and the whole _row.

    Labels become their sorted place through a join, so no label list reaches the driver.
    """
    frame = df
    dates, text = set(names.date_columns(df)), set(names.text_columns(df))
    numbers = {}
    for c in columns:
        if c in text:
            codes = label_codes(df, c).select(F.col("value").alias(f"_v_{c}"),
                                              F.col("code").cast("double").alias(f"_c_{c}"))
            frame = frame.join(codes, F.col(c) == F.col(f"_v_{c}"), "left")
            numbers[c] = F.col(f"_c_{c}")
        elif c in dates:
            numbers[c] = F.unix_seconds(F.col(c).cast("timestamp")).cast("double")
        else:
            numbers[c] = F.col(c).cast("double")
    return written(frame.select(
        row_id, F.struct(*df.columns).alias("_row"),
        *[F.coalesce(e, F.lit(-1.0)).alias(f"f_{c}") for c, e in numbers.items()],
        *[e.isNull().cast("double").alias(f"m_{c}") for c, e in numbers.items()]))


def _forest(df: DataFrame, encoded: DataFrame, row_id: str, column: str, features: Sequence[str], known: int,
            trees: int, options: ForestOptions) -> Callable[[DataFrame, str], DataFrame] | None:
    """What adds the predicted value to encoded rows, null where the column is known; None if it cannot be learned."""
    is_text = column in names.text_columns(df)
    labels = df.select(column).na.drop().distinct()
    n_labels = (labels if is_text else labels.limit(vocab.FOREST_CLASS_DISTINCT + 1)).count()
    classify = is_text or n_labels <= vocab.FOREST_CLASS_DISTINCT
    if n_labels < 1:
        return None
    numbers, flags = [f"f_{c}" for c in features], [f"m_{c}" for c in features]
    lost = F.col(f"m_{column}") == 1
    learn = encoded.where(~lost).withColumn("_y", F.col(f"f_{column}"))
    if not classify:
        return _added(*_learned(RandomForestRegressor, learn, numbers, flags, row_id, known, trees, options), lost)
    values = df.select(F.col(column).cast("string").alias("value"),
                       F.col(column).cast("double").alias("_n") if not is_text
                       else F.lit(None).cast("double").alias("_n")).na.drop(
        subset=["value"]).distinct()
    back = written(global_index(values, ["value"], "_label"))  # one row per label
    if not is_text:
        learn = learn.join(F.broadcast(back), F.col("_y") == F.col("_n")).withColumn(
            "_y", F.col("_label").cast("double")).drop("value", "_n", "_label")
    if n_labels <= MAX_CLASSES:
        model, steps = _learned(RandomForestClassifier, learn, numbers, flags, row_id, known, trees, options)
        model.setRawPredictionCol("").setProbabilityCol("")
        return _added(model, steps, lost, [r["value"] for r in back.orderBy("_label").collect()])
    guess = _vote(learn.select(row_id, "_y", *numbers, *flags), encoded.where(lost).select(row_id, *numbers, *flags),
                  numbers, flags, row_id, n_labels, trees, options)
    guess = guess.join(back, F.col("_code") == F.col("_label"))
    return lambda frame, name: frame.join(guess.select(row_id, F.col("value").alias(name)), row_id, "left")


def _added(model, steps: Sequence, lost: Column, labels: Sequence[str] | None = None):
    """Prediction as a projection: only rows that lack the column go through the trees, and no join brings it back."""

    def add(frame: DataFrame, name: str) -> DataFrame:
        out = frame
        for step in [*steps, model]:
            out = step.transform(out)
        value = F.col("prediction")
        if labels is not None:
            value = F.element_at(F.array(*[F.lit(x) for x in labels]), value.cast("int") + 1)
        return out.select(*frame.columns, F.when(lost, value).alias(name))

    return add


def _learned(kind, learn: DataFrame, numbers: Sequence[str], flags: Sequence[str], row_id: str, known: int,
             trees: int, options: ForestOptions) -> tuple:
    """A forest that learned _y from all rows, and the steps that make its features.

    Over WHOLE_ROWS rows, Spark would look for the bounds of bins in a sample; `_bins` finds them in all rows.
    """
    if known > max(WHOLE_ROWS, options.merge_rows):
        steps, merged = _merged(learn, numbers, flags, row_id, options, kind is RandomForestClassifier)
        return _learner(kind, merged.count(), trees, options, weightCol="_weight").fit(merged), steps
    steps = ([VectorAssembler(inputCols=[*numbers, *flags], outputCol="features")] if known <= WHOLE_ROWS
             else _bins(learn, numbers, flags)[0])
    rows = learn
    for step in steps:
        rows = step.transform(rows)
    return _fit(kind, rows.select("features", "_y", row_id), row_id, known, trees, options), steps


def _bins(learn: DataFrame, numbers: Sequence[str], flags: Sequence[str]) -> tuple[list, list[str]]:
    """Steps that make features in which numbers of over MAX_BINS values are their bin over all rows; their inputs."""
    ranks = [i / MAX_BINS for i in range(1, MAX_BINS)]
    seen = learn.agg(*[F.approx_count_distinct(c, 0.01).alias(f"n_{c}") for c in numbers],
                     *[F.percentile_approx(c, ranks, 10_000).alias(f"q_{c}") for c in numbers]).first()
    edges = {c: _edges(seen[f"q_{c}"]) for c in numbers if seen[f"n_{c}"] > MAX_BINS}
    inputs = [f"_bin_{c}" if c in edges else c for c in numbers] + list(flags)
    steps: list = [Bucketizer(inputCols=list(edges), outputCols=[f"_bin_{c}" for c in edges],
                              splitsArray=list(edges.values()), handleInvalid="keep")] if edges else []
    return [*steps, VectorAssembler(inputCols=inputs, outputCol="features")], inputs


def _merged(learn: DataFrame, numbers: Sequence[str], flags: Sequence[str], row_id: str, options: ForestOptions,
            classify: bool = False) -> tuple[list, DataFrame]:
    """Steps that make the features, and the training rows with those alike in all features merged.

    A forest looks at MAX_BINS bins of a number and at sums per bin. So numbers of more values become
    their bin, over all rows, and rows of equal features one row that weighs their count, with their mean
    (to classify, one row per label): splits and leaves have the same sums. The rows of one vector stay in
    several slices, so that trees still draw different rows. The number of vectors is bounded by the bins
    and labels, not by the rows.
    """
    steps, inputs = _bins(learn, numbers, flags)
    alike = [*inputs, "_y"] if classify else inputs
    binned = steps[0].transform(learn) if len(steps) > 1 else learn
    vectors = binned.groupBy(*alike).agg(F.count("*").alias("n")).count()
    slices = max(LEAST_SLICES, -(-options.merge_rows // max(1, vectors)))
    part = F.pmod(F.xxhash64(row_id), F.lit(slices)).alias("_slice")
    weight = F.count("*").cast("double").alias("_weight")
    groups = binned.groupBy(*alike, part)
    merged = written(groups.agg(weight) if classify else groups.agg(F.avg("_y").alias("_y"), weight))
    # a fixed row order inside fixed partitions, as for single rows
    keys = [*alike, "_slice"]
    merged = merged.repartition(max(8, merged.count() // 100_000), *keys).sortWithinPartitions(*keys)
    return steps, steps[-1].transform(merged).select("features", "_y", "_weight")


def _edges(quantiles: Sequence[float]) -> list[float]:
    """Bounds of bins; a value that takes several quantiles is a bin of its own."""
    heavy = {a for a, b in zip(quantiles, quantiles[1:]) if a == b}
    bounds = {min(v, sys.float_info.max) for v in (*quantiles, *(math.nextafter(v, math.inf) for v in heavy))}
    return [-math.inf, *sorted(bounds - {-math.inf}), math.inf]


def _learner(kind, rows: int, trees: int, options: ForestOptions, **more):
    """A seeded forest that finds the bounds of its bins in all rows.

    Spark looks for them in max(maxBins ** 2, WHOLE_ROWS) rows. Over WHOLE_ROWS rows come in `_bins`, so
    a larger maxBins makes that all rows and adds no bin.
    """
    bins = MAX_BINS if rows <= WHOLE_ROWS else min(MOST_BINS, max(MAX_BINS, math.isqrt(rows - 1) + 1))
    return kind(featuresCol="features", labelCol="_y", numTrees=trees, maxDepth=options.depth, seed=options.seed,
                maxBins=bins, **more)


def _fit(kind, learn: DataFrame, row_id: str, known: int, trees: int, options: ForestOptions):
    """A seeded forest of all rows given."""
    # a fixed row order inside fixed partitions makes the seeded forest repeatable
    learn = learn.repartition(max(8, learn.count() // 100_000), row_id).sortWithinPartitions(row_id)
    return _learner(kind, known, trees, options).fit(learn)


def _vote(learn: DataFrame, unknown: DataFrame, numbers: Sequence[str], flags: Sequence[str], row_id: str,
          n_labels: int, trees: int, options: ForestOptions) -> DataFrame:
    """(row id, _code) of the label predicted for each row.

    Codes are read as digits to the base MAX_CLASSES, one digit per step from the highest: a
    forest for each block of labels that rows were sent to, learned from all rows of the block. So there
    are about as many forests as blocks, each with its own bins.
    """
    steps = 1
    while MAX_CLASSES ** steps < n_labels:
        steps += 1
    learn, unknown = written(learn), written(unknown)
    sent = unknown.withColumn("_code", F.lit(0).cast("bigint"))
    for step in range(steps):
        place = F.floor(F.col("_y") / MAX_CLASSES ** (steps - 1 - step))
        digit = (place % MAX_CLASSES).cast("double")
        blocks = {
            r["block"]: (r["n"], r["digits"]) for r in learn.groupBy(
                F.floor(place / MAX_CLASSES).alias("block")).agg(
                F.count("*").alias("n"), F.count_distinct(digit).alias("digits")).collect()}
        wanted = [0] if step == 0 else sorted(
            r["_code"] for r in sent.select("_code").distinct().collect())
        parts = None
        for block in wanted:
            n, digits = blocks[block]
            own = learn.where(F.floor(place / MAX_CLASSES) == block).withColumn("_y", digit)
            rows = sent.where(F.col("_code") == block)
            if digits == 1:
                part = rows.withColumn("prediction", F.lit(own.first()["_y"]))
            else:
                model, makers = _learned(RandomForestClassifier, own, numbers, flags, row_id, n, trees, options)
                part = rows
                for maker in [*makers, model]:
                    part = maker.transform(part)
            part = written(part.select(row_id, *numbers, *flags, (
                F.col("_code") * MAX_CLASSES + F.col("prediction").cast("bigint")).alias("_code")))
            parts = part if parts is None else parts.unionByName(part)
        sent = parts if parts is not None else sent
    return sent.select(row_id, "_code")
