"""Texts as blocks of word numbers: the unit in which words are asked for and answered.

A block holds the rows of its texts, the number of words of each, the distinct hashes of its
words, and one number per word. Blocks are written once and joined with answers by their name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import PLAIN, SLICE_BYTES, words_of


def pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, dtype, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype) if n else np.zeros(0, dtype)


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on; equal bytes of all numbers are stored together, so small ones take little."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, np.uint8, 8 * n).reshape(8, -1).T).view("<u8").ravel() if n else np.zeros(0, np.uint64)


def text_blocks(docs: DataFrame, block_words: int, *, lower: bool = True, strings: bool = False,
                slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs: row, held, text -> block, rows, held, counts, words, n_words (distinct), vocab, ids, strings, lengths.

    With `strings`, the distinct words themselves stand for their hashes, in the same order.
    """

    def flush(parts, rows, held, texts) -> pa.RecordBatch:
        rows, held = pa.concat_arrays(rows), np.concatenate(held)
        vocab, ids, times = np.unique(np.concatenate([p.hashes for p in parts]), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vocab, ids = vocab[order], rank[ids]
        counts = np.concatenate([p.counts for p in parts]).astype(np.int64)
        named = [b"", b""]
        if strings:
            own = [texts[int(v)] for v in vocab.tolist()]
            named = [pa.compress(b"".join(own), "zstd", asbytes=True), pack_numbers(np.array([len(x) for x in own], np.int64))]
        return pa.RecordBatch.from_arrays([
            pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
            pa.array([held.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
            pa.array([len(ids)], pa.int64()), pa.array([len(vocab)], pa.int64()), pa.array([b"" if strings else vocab.tobytes()], pa.binary()), pa.array([pack_numbers(ids)], pa.binary()),
            *[pa.array([x], pa.binary()) for x in named]],
            ["block", "rows", "held", "counts", "words", "n_words", "vocab", "ids", "strings", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, held, texts, n = [], [], [], {}, 0
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for part in words_of(batch.column(2), PLAIN, slice_bytes, lower):
                if strings:
                    new, first = np.unique(part.hashes, return_index=True)
                    unknown = [i for i, v in enumerate(new.tolist()) if v not in texts]
                    texts.update(zip(new[unknown].tolist(), part.strings(first[unknown])))
                part.data = part.starts = part.ends = None
                parts.append(part)
                rows.append(batch.column(0).slice(part.first, len(part.counts)))
                held.append(flags[part.first: part.first + len(part.counts)])
                n += len(part.hashes) + len(part.counts)
                if n >= block_words:
                    yield flush(parts, rows, held, texts)
                    parts, rows, held, texts, n = [], [], [], {}, 0
        if parts:
            yield flush(parts, rows, held, texts)

    binary = [T.StructField(c, T.BinaryType()) for c in ("held", "counts", "vocab", "ids", "strings", "lengths")]
    held, counts, vocab, ids, texts, lengths = binary
    return docs.mapInArrow(run, T.StructType([
        T.StructField("block", T.StringType()), T.StructField("rows", T.ArrayType(docs.schema["row"].dataType)), held, counts,
        T.StructField("words", T.LongType()), T.StructField("n_words", T.LongType()), vocab, ids, texts, lengths]))
