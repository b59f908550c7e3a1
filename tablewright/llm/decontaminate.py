"""Benchmark decontamination by winnowed fingerprints.

Every run of `window` consecutive benchmark words that a document repeats is found. Both sides
are winnowed: of the hashes of `gram` consecutive words, the smallest of each run of
``window - gram + 1`` neighbours is a fingerprint, so a shared run of `window` words always
shares one. Documents look their fingerprints up among those of the benchmark, and a match is
extended: each run of `window` words around it counts only if a whole benchmark window has the
same 64-bit hash. Items shorter than a window are one window of their own length.

The benchmark is read in blocks of at most `block_windows` windows, so what is sent to the tasks
is bounded whatever its size; documents pass once per block, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import free_name
from .tokens import ALPHANUMERIC, U, grams, inside_one_text, join_hash, words_of

WINDOW, GRAM = 10, 5
BLOCK_WINDOWS = 1_000_000
NONE = U(0xFFFFFFFFFFFFFFFF)

_HITS = "struct<n_words: bigint, spans: array<struct<begin: int, end: int>>, items: array<string>>"
_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def item_windows(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per item and window: item, size (words in it), gram hash `hash`, all 5-gram hashes within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for words in words_of(batch.column(1), ALPHANUMERIC):
                bounds = words.bounds
                for i, n in enumerate(words.counts.tolist()):
                    size = min(n, window)
                    if size:
                        own = words.hashes[bounds[i]: bounds[i + 1]]
                        found = np.unique(grams(own, size))
                        yield pa.RecordBatch.from_arrays(
                            [names.slice(words.first + i, 1).take(pa.array(np.zeros(len(found), np.int64))),
                             pa.array(np.full(len(found), size, np.int32)),
                             pa.array(found.view(np.int64))], ["item", "size", "hash"])

    return items.select(F.col(item_id).cast("string"), F.col(text)).mapInArrow(run, "item string, size int, hash bigint")


def item_fingerprints(items: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text") -> DataFrame:
    """Distinct winnowed fingerprints of the items that hold a whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(0), ALPHANUMERIC):
                marks, hashes = fingerprints(words.hashes, words.counts, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes[marks]).view(np.int64))], ["hash"])

    return items.select(F.col(text)).mapInArrow(run, "hash bigint").distinct()


def fingerprints(hashes: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places hold the smallest gram hash of some run of neighbours, and the gram hashes."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64), np.full(n, NONE, U)
    values = np.full(n, NONE, U)
    own = grams(hashes, gram)
    values[: len(own)] = own
    values[~inside_one_text(counts, gram)] = NONE
    run = window - gram + 1
    whole = inside_one_text(counts, window)  # runs of neighbours that lie in one text
    least = values.copy()
    for i in range(1, run):
        least[: n - i] = np.minimum(least[: n - i], values[i:])
    marked = np.zeros(n, bool)
    for i in range(run):
        if n > i:
            marked[i:] |= whole[: n - i] & (least[: n - i] == values[i:])
    return np.flatnonzero(marked), values


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership among sorted distinct values."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


class Lookup:
    """One block of the benchmark: sorted windows by size, the items of each, fingerprints."""

    def __init__(self, item: list[str], size: np.ndarray, window_hash: np.ndarray, prints: np.ndarray):
        self.names = np.array(sorted({name for name in item if name is not None}), dtype=object)
        place = {name: i for i, name in enumerate(self.names)} | {None: len(self.names)}
        code = np.array([place[x] for x in item], np.int64)
        self.by_size = {}
        for n in sorted(set(size.tolist())):
            own = size == n
            order = np.lexsort((code[own], window_hash[own]))
            sorted_hash = window_hash[own][order]
            known, first = np.unique(sorted_hash, return_index=True)
            self.by_size[int(n)] = (known, np.append(first, len(sorted_hash)), code[own][order])
        self.prints = np.sort(prints)


def _found(lookup: Lookup, hashes: np.ndarray, counts: np.ndarray, window: int, gram: int):
    """Windows that occur: begin, size, place among the known windows of that size."""
    for size, (known, _, _) in lookup.by_size.items():
        if size == window:
            marks, values = fingerprints(hashes, counts, window, gram)
            hits = marks[_is_in(values[marks], lookup.prints)]
            # extend: any window that holds the fingerprint may be shared
            begins = np.unique((hits[:, None] - np.arange(window - gram + 1)[None, :]).ravel())
            begins = begins[begins >= 0]
            begins = begins[inside_one_text(counts, window)[begins]]
        else:
            begins = np.flatnonzero(inside_one_text(counts, size))
        if len(begins):
            from_here = hashes[begins]
            for i in range(1, size):
                from_here = join_hash(from_here, hashes[begins + i])
            same = _is_in(from_here, known)
            if same.any():
                yield begins[same], size, np.searchsorted(known, from_here[same])


def _hits_of(texts: pa.Array, lookup: Lookup | None, window: int, gram: int) -> pa.Array:
    n_words, span_rows, item_rows = [], [], []
    for words in words_of(texts, ALPHANUMERIC):
        counts, bounds = words.counts, words.bounds
        n_words += counts.tolist()
        edge = np.zeros(len(words.hashes) + 1, np.int32)
        pairs = []
        for begin, size, at in _found(lookup, words.hashes, counts, window, gram) if lookup else ():
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + size, -1)
            _, first, code = lookup.by_size[size]
            text = np.searchsorted(bounds, begin, "right") - 1
            many = first[at + 1] - first[at]
            places = np.repeat(first[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            pairs.append(np.unique(np.repeat(text, many) * (len(lookup.names) + 1) + code[places]))
        hit = np.cumsum(edge[:-1]) > 0
        spans: dict[int, list] = {}
        items: dict[int, list] = {}
        if pairs:
            for pair in np.unique(np.concatenate(pairs)).tolist():
                text, code = divmod(pair, len(lookup.names) + 1)
                items.setdefault(text, []).extend(lookup.names[code: code + 1])  # an item without an id has no name
            for text in items:
                own = np.diff(np.concatenate(([0], hit[bounds[text]: bounds[text + 1]].astype(np.int8), [0])))
                spans[text] = [{"begin": int(a), "end": int(b)}
                               for a, b in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1))]
        for i in range(len(counts)):
            span_rows.append(spans.get(i, []))
            item_rows.append(items.get(i, []))
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(span_rows, _SPANS), pa.array(item_rows, pa.list_(pa.string()))],
        ["n_words", "spans", "items"])


def _blocks(items: DataFrame, window: int, gram: int, block_windows: int,
            item_id: str, text: str) -> Iterator[Lookup]:
    """The benchmark in bounded parts; items are split, not windows of one item."""
    windows = item_windows(items, window, item_id, text).distinct()
    n = windows.count()
    parts = -(-n // block_windows)
    for part in range(parts):
        rows = windows.filter(F.pmod(F.xxhash64("hash", "size"), F.lit(parts)) == part).toArrow()
        # fingerprints of the whole benchmark would do; those of the items of this block are fewer
        own = items.join(windows.filter(F.pmod(F.xxhash64("hash", "size"), F.lit(parts)) == part)
                          .select(F.col("item").alias("_item")).distinct(),
                          F.col(item_id).cast("string").eqNullSafe(F.col("_item")), "left_semi") if parts > 1 else items
        prints = item_fingerprints(own, window, gram, text).toArrow()["hash"].to_numpy().view(U)
        yield Lookup(rows["item"].to_pylist(), rows["size"].to_numpy(), rows["hash"].to_numpy().view(U), prints)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW,
                  gram: int = GRAM, block_windows: int = BLOCK_WINDOWS, into: str = "_overlap",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add a struct column `into`: n_words, spans (begin, end in words), items (their ids as text).

    Words are runs of a-z, 0-9 and characters beyond ASCII after lowering A-Z. A null or empty
    text has no words and no spans; items without words match nothing; items without an id
    give spans but no name; repeated items all count, repeated documents each get their own row; an empty benchmark gives no
    spans. Other columns are kept whatever their names, but `into` is replaced if present.
    """
    spark = docs.sparkSession
    found, more = None, free_name([*docs.columns, into], "_more")
    for lookup in [*_blocks(benchmark, window, gram, block_windows, item_id, item_text)] or [None]:
        shared = spark.sparkContext.broadcast(lookup)

        @F.arrow_udf(_HITS)
        def overlaps(texts: pa.Array) -> pa.Array:
            return _hits_of(texts, shared.value, window, gram)

        own = overlaps(F.col(text))
        if found is None:
            found = docs.withColumn(into, own)
        else:
            found = found.withColumn(more, own).withColumn(into, F.struct(
                F.col(f"{into}.n_words").alias("n_words"),
                F.concat(f"{into}.spans", f"{more}.spans").alias("spans"),
                F.array_distinct(F.concat(f"{into}.items", f"{more}.items")).alias("items"))).drop(more)
    return found


@F.arrow_udf(T.LongType())
def words_in_spans(spans: pa.Array) -> pa.Array:
    """Words covered by possibly overlapping spans."""
    out = []
    for row in spans.to_pylist():
        total = reach = 0
        for begin, end in sorted((s["begin"], s["end"]) for s in row or ()):
            total += max(0, end - max(begin, reach))
            reach = max(reach, end)
        out.append(total)
    return pa.array(out, pa.int64())


@F.arrow_udf(T.StringType())
def digest_of_items(items: pa.Array) -> pa.Array:
    """SHA-256 of the sorted ids, joined by commas."""
    return pa.array([hashlib.sha256(",".join(sorted(row or ())).encode()).hexdigest() for row in items.to_pylist()])


def overlap_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Nulls, empty texts, repeated rows and empty tables as in `find_overlaps`: each row of docs gives one row, clean
    ones with n_hit 0 and the digest of no items.
    """
    found = find_overlaps(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id", F.col("_overlap.n_words").alias("n_words"),
        words_in_spans(F.col("_overlap.spans")).alias("n_hit"),
        F.size("_overlap.items").cast("bigint").alias("n_items"),
        digest_of_items(F.col("_overlap.items")).alias("items_sha256"),
        (F.size("_overlap.spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, columns unchanged, that repeat no benchmark window.

    Null and empty texts repeat none and stay, as does every row under an empty benchmark; repeated rows stay or go
    together; items without an id count too.
    """
    names = docs.columns
    mark = next(f"_overlap{i}" for i in range(len(names) + 1) if f"_overlap{i}" not in names)
    found = find_overlaps(docs, benchmark, into=mark, **options)
    return found.filter(F.size(f"{mark}.spans") == 0).select(*[F.col(f"`{c}`") for c in names])
