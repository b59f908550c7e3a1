"""Language identification by Bayesian fusion of text, markup, address and host.

Each language has counts of letter trigrams (bytes, hashed to 65,536 bins) over all labelled
texts, added up by grouped aggregation. The likelihood of a text under each language is fused with
further evidence, whose distributions are grouped counts of the best language by text alone:

    P(language | all) ~ P(text | language) * P(declared | language) * P(suffix | language) * P(language | host)

The prior of a host is smoothed towards that of its registered domain, and that towards the
share of the language in all rows. A row's own vote is left out of every count it is judged by.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boilerplate import host_of, page_blocks
from .page_structure import CONTENT, OPEN
from .scratch import Tables
from .tokens import text_bytes

BINS_LOG = 16
SLICE = 2 << 20
STRENGTH = 4.0       # rows that a smoothed distribution counts for
TEMPER = 1 / 3       # a byte is in three trigrams
MIN_CONFIDENCE = 0.5
OUTPUT = ("language", "confidence", "text_language", "rejected")

_LETTER = np.full(256, 32, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def trigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: first row, rows, then row and bin of each trigram with a letter in the middle."""
    data, bounds = text_bytes(texts)
    row, n = 0, len(texts)
    while row < n:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE, "right")) - 1)
        own = bounds[row: to + 1] - bounds[row]
        length = int(own[-1])
        for at in range(0, max(length, 1), SLICE):  # a longer text comes in pieces that overlap by two bytes
            end = min(length, at + SLICE + 2)
            letters = _LETTER[data[int(bounds[row]) + at: int(bounds[row]) + end]].astype(np.uint32)
            first = np.flatnonzero(letters[1:-1] != 32) if len(letters) > 2 else np.zeros(0, np.int64)
            text = np.searchsorted(own, first + at, "right") - 1
            whole = first + at + 3 <= own[text + 1] if len(first) else np.zeros(0, bool)
            first, text = first[whole], text[whole]
            bins = ((letters[first] << np.uint32(16) | letters[first + 1] << np.uint32(8) | letters[first + 2]) * np.uint32(2654435769)) >> np.uint32(32 - BINS_LOG)
            yield row, to - row, text, bins
        row = to


def trigram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns lang, bin, n over all labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, rows, text, bins in trigrams(batch.column(1)):
                own = np.array(names[first: first + rows], dtype=object)
                for name in set(own.tolist()):
                    mine = (own == name)[text]
                    total.setdefault(name, np.zeros(1 << BINS_LOG, np.int64))
                    total[name] += np.bincount(bins[mine], minlength=1 << BINS_LOG)
        for name, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])], ["lang", "bin", "n"])

    labelled = docs.select(primary(F.col(lang)).alias("lang"), F.col(text)).filter("lang is not null")
    return labelled.mapInArrow(run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def primary(tag: Column) -> Column:
    """First part of a language tag in lower case; null if there is none."""
    first = F.lower(F.regexp_extract(F.trim(tag.cast("string")), r"^([A-Za-z]+)", 1))
    return F.when(F.length(first) > 0, first)


def text_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each bin: languages x 65,536 numbers."""
    rows = trigram_counts(docs, text, lang).toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((len(names), 1 << BINS_LOG))
    at = np.array([names.index(x) for x in rows["lang"].to_pylist()], np.int64)
    counts[at, rows["bin"].to_numpy()] = rows["n"].to_numpy()
    return names, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << BINS_LOG))) if names else counts


def likelihoods(docs: DataFrame, model: np.ndarray, text: str) -> Column:
    """Struct of n (trigrams with letters) and logs (log likelihood per language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    @F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("logs", T.ArrayType(T.DoubleType()))]))
    def measure(texts: pa.Array) -> pa.Array:
        model = shared.value
        n, logs = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(model)))
        for first, rows, text, bins in trigrams(texts):
            n[first: first + rows] += np.bincount(text, minlength=rows)
            for i, own in enumerate(model):
                logs[first: first + rows, i] += np.bincount(text, own[bins], rows)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(model), pa.int32()), pa.array(logs.ravel()))
        return pa.StructArray.from_arrays([pa.array(n), flat], ["n", "logs"])

    return measure(F.col(text))


def _votes(evidence: DataFrame, key: str, n_languages: int) -> DataFrame:
    """Votes per value and language."""
    return evidence.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(
        F.array(*[F.sum((F.col("best") == i).cast("bigint")) for i in range(n_languages)]).alias(f"{key}_votes"))


def _add(a: Column, b: Column, op) -> Column:
    return F.zip_with(a, b, op)


def _smoothed(votes: str, prior: str, total: Column) -> Column:
    """Shares of the votes, smoothed towards a prior."""
    return _add(F.col(votes), F.col(prior), lambda x, p: (x + STRENGTH * p) / (total + STRENGTH))


def _given(votes: str, overall: Column) -> Column:
    """Share of a value among the rows of each language, smoothed towards its share in all rows."""
    return _add(F.col(votes), F.col("all_left"), lambda x, a: (x + STRENGTH * overall) / (a + STRENGTH))


def fuse(evidence: DataFrame, names: list[str], tables: Tables) -> DataFrame:
    """row, n, logs, declared, suffix, host, parent -> row plus language, confidence, text_language, rejected."""
    k = len(names)
    languages = F.array(*[F.lit(x) for x in names])
    evidence = tables.write(evidence.withColumn("best", F.when(F.col("n") > 0, (F.array_position("logs", F.array_max("logs")) - 1).cast("int"))))
    total = [int(x or 0) for x in evidence.agg(*[F.sum((F.col("best") == i).cast("bigint")) for i in range(k)]).first()]
    joined = evidence
    for key in ("declared", "suffix", "parent", "host"):
        # one row per distinct value; Spark sends it whole only below its size threshold
        joined = joined.join(_votes(evidence, key, k), F.col(key) == F.col(f"_{key}"), "left")
    own = F.array(*[F.coalesce((F.col("best") == i).cast("double"), F.lit(0.0)) for i in range(k)])
    zero = F.array(*[F.lit(0.0) for _ in range(k)])
    cast = lambda c: F.coalesce(F.transform(c, lambda x: x.cast("double")), zero)
    less = lambda c: F.transform(_add(c, F.col("own"), lambda a, b: a - b), lambda x: F.greatest(x, F.lit(0.0)))
    summed = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    frame = joined.select("row", "n", "logs", "best", "declared", "suffix", "host", "parent", own.alias("own"),
                          *[cast(F.col(f"{key}_votes")).alias(f"{key}_votes") for key in ("declared", "suffix", "parent", "host")],
                          F.array(*[F.lit(float(x)) for x in total]).alias("all"))
    frame = frame.select("*", *[F.when(F.col(key).isNotNull(), less(F.col(f"{key}_votes"))).otherwise(zero).alias(f"{key}_left")
                                for key in ("declared", "suffix", "parent", "host")], less(F.col("all")).alias("all_left"))
    everything = summed(F.col("all_left"))
    frame = frame.withColumn("share", F.transform("all_left", lambda x: (x + 1) / (everything + k)))
    for key, above in (("parent", "share"), ("host", "parent_prior")):
        frame = frame.withColumn(f"{key}_prior", _smoothed(f"{key}_left", above, summed(F.col(f"{key}_left"))))
    for key in ("declared", "suffix"):
        overall = (summed(F.col(f"{key}_left")) + 0.5) / (everything + 1)
        frame = frame.withColumn(f"{key}_given", F.when(F.col(key).isNotNull(), _given(f"{key}_left", overall)).otherwise(
            F.transform(zero, lambda x: x + 1)))
    log = lambda c: F.transform(c, lambda x: F.log(F.greatest(x, F.lit(1e-300))))
    plus = lambda a, b: _add(a, b, lambda x, y: x + y)
    score = plus(plus(F.transform("logs", lambda x: x * TEMPER), log(F.col("host_prior"))), plus(log(F.col("declared_given")), log(F.col("suffix_given"))))
    frame = frame.withColumn("score", score).withColumn("top", F.array_max("score"))
    frame = frame.withColumn("confidence", 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    noise = F.array_max("logs") < F.col("n") * F.lit(-float(BINS_LOG * np.log(2)))  # less likely than by chance
    rejected = (F.col("n") == 0) | noise | (F.col("confidence") < MIN_CONFIDENCE)
    return frame.select(
        "row", F.element_at(languages, F.array_position("score", F.col("top")).cast("int")).alias("language"), "confidence",
        F.when(F.col("n") > 0, F.element_at(languages, F.col("best") + 1)).alias("text_language"), F.coalesce(rejected, F.lit(True)).alias("rejected"))


def identify(frame: DataFrame, labelled: DataFrame, *, text: Column, declared: Column, host: Column, suffix: Column, parent: Column,
             columns: Sequence[str] | None = None) -> DataFrame:
    """The given columns (all by default) plus language, confidence, text_language, rejected.

    `labelled` has text and lang. Evidence that is null does not count. A text without letters, one
    less likely under every language than by chance, and one whose best language has a
    confidence under 0.5 are rejected; without letters the language is that of the other
    evidence. Without labelled texts language is null and every row is rejected. Repeated rows
    each get their result. Columns named like an output are replaced. No rows in, no rows out.
    """
    kept = [c for c in (frame.columns if columns is None else columns) if c.lower() not in OUTPUT]
    names, model = text_model(labelled)
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    if not names:
        return frame.select(row).select("row.*", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"),
                                        F.lit(None).cast("string").alias("text_language"), F.lit(True).alias("rejected"))
    evidence = frame.select(row, text.alias("_text"), primary(declared).alias("declared"), suffix.alias("suffix"), host.alias("host"), parent.alias("parent"))
    measured = evidence.withColumn("m", likelihoods(frame, model, "_text")).select("row", "m.n", "m.logs", "declared", "suffix", "host", "parent")
    return fuse(measured, names, Tables(frame.sparkSession, "language")).select("row.*", *OUTPUT)


def identify_pages(pages: DataFrame, labelled: DataFrame, columns: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Language of web pages: main text, lang of the html element, last part of the host, host and its registered domain."""
    parts = pages.withColumn("_parts", page_blocks("html"))
    of = lambda kind: F.concat_ws(" ", F.transform(F.filter("_parts", lambda b: b["kind"] == kind), lambda b: b["text"]))
    text = F.when(F.length(of(CONTENT)) > 0, of(CONTENT)).otherwise(of(OPEN))
    host = host_of(F.col("url"))
    labels = F.split(host, "\\.")
    return identify(parts, labelled, text=text, declared=F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1), host=host,
                    suffix=F.element_at(labels, -1), parent=F.when(
                        F.size(labels) >= 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(host), columns=list(columns))


def known_language(docs: DataFrame) -> DataFrame:
    """Documents that are not rejected, columns unchanged; the lang column is the declared language, the source the host."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text").alias("_body"), F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    found = identify(packed, docs.select("text", "lang"), text=F.col("_body"), declared=F.col("_lang"), host=F.col("_source").cast("string"),
                     suffix=F.lit(None).cast("string"), parent=F.lit(None).cast("string"), columns=["_row"])
    return found.filter("not rejected").select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
