"""Toxicity score by a counterfactual-regularised linear classifier.

Features of a text are the distinct hashes of its words and of the beginnings (3 to 8 bytes) of
longer words. Those that differ between labels (z above a threshold) get a weight by logistic
regression. For every training text with an identity term, the same text with the term swapped
for another of its group must score alike: the squared change of the score is part of the loss,
so a group's mere mention moves the score little.

The classifier is fitted in one task on at most `max_rows` labelled texts, chosen by a hash of
their id among all that may be learned from; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Tables
from .tokens import ALPHANUMERIC, U, mix, words_of
from .tokens import _hashes as hashes_between

MAX_ROWS, MAX_FEATURES, MIN_TEXTS, MIN_Z = 8000, 5000, 3, 2.5
BEGINNINGS = (3, 4, 5, 6, 7, 8)
STEPS, RATE, RIDGE, SWAP_PENALTY, POSITIVE_WEIGHT = 300, 0.5, 1e-4, 1.0, 3.0
OUTPUT = ("score", "predicted")

#: Terms that name groups of people; terms of one line can stand for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrant", "citizen", "refugee"),
    ("old", "young"),
    ("blind", "deaf", "disabled"),
)


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice of rows: first row, row and feature of each distinct (row, feature), sorted."""
    for part in words_of(texts, ALPHANUMERIC):
        row = np.repeat(np.arange(len(part.counts)), part.counts)
        rows, values = [row], [part.hashes]
        for length in BEGINNINGS:
            longer = np.flatnonzero(part.ends - part.starts > length)
            rows.append(row[longer])
            values.append(mix(hashes_between(part.data, part.starts[longer], part.starts[longer] + length) + U(length)))
        both = np.unique((np.concatenate(rows).astype(U) << U(32)) | (np.concatenate(values) >> U(32)))
        yield part.first, (both >> U(32)).astype(np.int64), (both & U(0xFFFFFFFF)).astype(np.uint32)


def _swaps(rows: Sequence[np.ndarray], names: np.ndarray, identity_terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature changes of all swaps: swap, place among names, sign, and how often each swap can be made."""
    swap, place, sign, weight = [], [], [], []
    for group in identity_terms:
        own = {}
        for term in group:
            _, _, found = next(features(pa.array([term])))
            own[term] = found
        for term in group:
            head = next(words_of(pa.array([term]), ALPHANUMERIC)).hashes[0] >> U(32)
            texts = sum(1 for r in rows if len(r) and r[min(np.searchsorted(r, np.uint32(head)), len(r) - 1)] == np.uint32(head))
            for other in group if texts else ():
                if other != term:
                    for found, s in ((own[other], 1.0), (own[term], -1.0)):
                        at = np.searchsorted(names, found)
                        at = at[(at < len(names))]
                        at = at[np.isin(names[at], found)]
                        swap += [len(weight)] * len(at)
                        place += at.tolist()
                        sign += [s] * len(at)
                    weight.append(texts)
    return np.array(swap, np.int64), np.array(place, np.int64), np.array(sign), np.array(weight, float)


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, identity_terms=IDENTITY_TERMS, swap_penalty: float = SWAP_PENALTY):
    """Sorted features, their weights, and the bias; a constant near the share of label 1 if one label is missing."""
    ones, zeros = int((labels == 1).sum()), int((labels == 0).sum())
    bias = float(np.log((ones + 0.5) / (zeros + 1)))
    if not ones or not zeros:
        return np.zeros(0, np.uint32), np.zeros(0), bias
    text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    every = np.concatenate(rows)
    values, place = np.unique(every, return_inverse=True)
    with_one = np.bincount(place, labels[text] == 1, len(values))
    with_zero = np.bincount(place, labels[text] == 0, len(values))
    a, b = (with_one + 0.5) / (ones + 1), (with_zero + 0.5) / (zeros + 1)
    z = np.abs(np.log(a / (1 - a)) - np.log(b / (1 - b))) / np.sqrt(1 / (with_one + 0.5) + 1 / (with_zero + 0.5))
    telling = np.flatnonzero((with_one + with_zero >= MIN_TEXTS) & (z > MIN_Z))
    telling = np.sort(telling[np.argsort(-z[telling], kind="stable")][:MAX_FEATURES])
    names = values[telling]
    number = np.full(len(values), -1)
    number[telling] = np.arange(len(telling))
    used = number[place] >= 0
    text, feature = text[used], number[place][used]
    swap, at, sign, times = _swaps(rows, names, identity_terms)
    weight, n = np.zeros(len(names)), len(rows)
    importance = np.where(labels == 1, POSITIVE_WEIGHT, 1.0)
    seen, seen_bias = np.zeros(len(names)), 0.0
    for _ in range(STEPS):
        score = bias + np.bincount(text, weight[feature], n)
        off = importance * (1 / (1 + np.exp(-score)) - labels) / n
        slope = np.bincount(feature, off[text], len(names)) + RIDGE * weight
        if len(times):
            change = np.bincount(swap, sign * weight[at], len(times))
            slope += swap_penalty * 2 * np.bincount(at, (times / n * change)[swap] * sign, len(names))
        seen += slope ** 2
        weight -= RATE * slope / np.sqrt(seen + 1e-8)
        seen_bias += off.sum() ** 2
        bias -= RATE * off.sum() / np.sqrt(seen_bias + 1e-8)
    return names, weight, float(bias)


def train(docs: DataFrame, labels: DataFrame, usable: Column, tables: Tables, *, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", max_rows: int = MAX_ROWS, identity_terms=IDENTITY_TERMS, swap_penalty: float = SWAP_PENALTY):
    """Fit on at most max_rows labelled texts; of several labels of an id the highest counts."""
    chosen = (labels.filter(usable).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
              .filter("id is not null and label is not null").orderBy(F.xxhash64("id"), "id").limit(max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, row, feature in features(batch.column(1)):
                n = int(row.max(initial=-1)) + 1
                bounds = np.searchsorted(row, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), pa.array([feature[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
                    ["label", "features"])

    # the chosen ids are at most max_rows; a repeated id could bring more texts, so they are bounded again
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), F.col("_id") == F.col("id")).select("label", "_text")
    found = tables.write(texts.mapInArrow(run, "label int, features binary").limit(max_rows))

    def learn(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["features"].to_pylist(), table["label"].to_pylist()))
        names, weight, bias = fit([np.frombuffer(r, np.uint32) for r, _ in rows], np.array([y for _, y in rows]), identity_terms, swap_penalty)
        return pa.table({"names": pa.array([names.tobytes()], pa.binary()), "weights": pa.array([weight.tobytes()], pa.binary()), "bias": [bias]})

    model = found.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "names binary, weights binary, bias double").first()
    if model is None:
        return fit([], np.zeros(0))
    return np.frombuffer(model["names"], np.uint32), np.frombuffer(model["weights"]), model["bias"]


def score_column(docs: DataFrame, model, text: str = "text") -> Column:
    """Probability of label 1 for each text; null and empty texts get that of the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        names, weight, bias = shared.value
        total = np.full(len(texts), bias)
        for first, row, feature in features(texts):
            if len(names):
                at = np.minimum(np.searchsorted(names, feature), len(names) - 1)
                total += np.bincount(row + first, np.where(names[at] == feature, weight[at], 0.0), len(texts))
        return pa.array(1 / (1 + np.exp(-total)))

    return score(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame, usable: Column, *, text: str = "text", **options) -> DataFrame:
    """All columns plus score (0 to 1) and predicted (1 from 0.5 on). `usable` is a condition on labels.

    The score depends on nothing but the text. Repeated rows score alike; labels without a text
    and texts without a label are fine; without labels of both kinds every text has the same
    score. Columns named like an output are replaced. No rows in, no rows out.
    """
    model = train(docs, labels, usable, Tables(docs.sparkSession, "toxicity"), text=text, **options)
    kept = [c for c in docs.columns if c.lower() not in OUTPUT]
    return (docs.select(*[F.col(f"`{c}`") for c in kept], score_column(docs, model, text).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
