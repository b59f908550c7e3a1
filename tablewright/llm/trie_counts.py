"""Token counts by a unigram model over a public vocabulary, with shared prefixes computed once.

Words are pre-tokens (runs without white space, case kept, led by U+2581). The tokens of a word
are its most probable split into pieces; of equally probable ones, the one of fewest pieces. A
piece's probability falls with its rank in the vocabulary (Zipf: 1 / (rank + 2.7)); a byte that no
piece covers is a token of its own, far less probable than any piece.

The distinct words of a bucket are put in a trie, and the forward scores are computed level by
level, once per node, so a prefix shared by many words costs once. Blocks of texts ask buckets
for their distinct words and get the terminal counts back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import pack_numbers, text_blocks, unpack_numbers
from .scratch import Tables
from .tokens import PLAIN, U, mix, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LEAD = "▁".encode()
TRIE_WORDS, TRIE_BYTES = 20_000, 256  # words in one trie; longer ones are split on their own
BLOCK_WORDS, BUCKET_WORDS = 2_000_000, 1_000_000
OUTPUT = ("n_words", "n_tokens")
_BASE = U(0x9E6C63D0676A9A99 | 1)


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Ordinary pieces of a vocabulary file in rank order, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [model.id_to_piece(i).encode() for i in ranked]


class Pieces:
    """Log probabilities of pieces, by their bytes and by a hash of their bytes."""

    def __init__(self, pieces: Sequence[bytes]):
        weights = [1 / (rank + 2.7) for rank in range(len(pieces))]
        total = math.log(sum(weights))
        self.score: dict[bytes, float] = {}
        for piece, weight in zip(pieces, weights):
            if piece:
                self.score.setdefault(piece, math.log(weight) - total)
        self.single = min(self.score.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.score), default=1)
        names = list(self.score)
        hashes = np.array([_hash_bytes(p) for p in names], U)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.scores = np.array([self.score[p] for p in names])[order]
        self.lengths = sorted({len(p) for p in names} | {1})


def _hash_bytes(piece: bytes) -> int:
    value = 0
    for byte in piece:
        value = (value * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
    return value


def count_word(word: bytes, pieces: Pieces) -> int:
    """Tokens of one word (lead included): the plain recurrence, for words too long for a trie."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        options = []
        for length in pieces.lengths:
            if length <= end:
                score = pieces.score.get(word[end - length: end], pieces.single if length == 1 else None)
                if score is not None:
                    options.append((best[end - length][0] + score, best[end - length][1] - 1))
        best[end] = max(options)
    return -best[-1][1]


def count_sorted(words: Sequence[bytes], pieces: Pieces) -> np.ndarray:
    """Tokens of distinct words in sorted order, by forward scores over their trie."""
    n = len(words)
    size = np.array([len(w) for w in words])
    depth = int(size.max(initial=0))
    letters = np.zeros((n, depth), np.uint8)
    inside = np.arange(depth) < size[:, None]
    letters[inside] = np.frombuffer(b"".join(words), np.uint8)
    differs = (letters[1:] != letters[:-1]) | (inside[1:] != inside[:-1])
    shared = np.zeros(n, np.int64)  # letters in common with the word before
    shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
    # prefix hashes: hash of letters a..b is up[b] - up[a] * base ** (b - a)
    powers = np.ones(depth + 1, U)
    up = np.zeros((n, depth + 1), U)
    with np.errstate(over="ignore"):
        for j in range(depth):
            powers[j + 1] = powers[j] * _BASE
            up[:, j + 1] = up[:, j] * _BASE + letters[:, j].astype(U) + U(1)
    out = np.zeros(n, np.int64)
    # per level: score and tokens of each node, and the node of each word
    scores, tokens, nodes = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(n, np.int64)]
    for j in range(depth):
        active = size > j
        new = active & ((shared <= j) | (np.arange(n) == 0))
        node_of = np.cumsum(new) - 1
        head = np.flatnonzero(new)  # the first word of each node
        best = np.full(len(head), -np.inf)
        least = np.zeros(len(head), np.int64)
        for length in pieces.lengths:
            if length > j + 1:
                break
            start = j + 1 - length
            with np.errstate(over="ignore"):
                value = up[head, j + 1] - up[head, start] * powers[length]
            at = np.minimum(np.searchsorted(pieces.hashes, value), len(pieces.hashes) - 1)
            hit = pieces.hashes[at] == value if len(pieces.hashes) else np.zeros(len(head), bool)
            score = np.where(hit, pieces.scores[at], pieces.single if length == 1 else -np.inf)
            from_node = nodes[start][head]
            total = scores[start][from_node] + score
            count = tokens[start][from_node] + 1
            better = (total > best) | ((total == best) & (count < least))
            best, least = np.where(better, total, best), np.where(better, count, least)
        scores.append(best)
        tokens.append(least)
        nodes.append(np.where(active, node_of, 0))
        ended = size == j + 1
        out[ended] = least[node_of[ended]]
    return out


def count_words(words: Sequence[bytes], pieces: Pieces) -> np.ndarray:
    """Tokens of each word (without lead), in the given order."""
    led = [LEAD + w for w in words]
    order = sorted(range(len(led)), key=led.__getitem__)
    out = np.zeros(len(led), np.int64)
    short = [i for i in order if len(led[i]) <= TRIE_BYTES]
    for at in range(0, len(short), TRIE_WORDS):
        own = short[at: at + TRIE_WORDS]
        out[own] = count_sorted([led[i] for i in own], pieces)
    for i in order:
        if len(led[i]) > TRIE_BYTES:
            out[i] = count_word(led[i], pieces)
    return out


_ASK_DDL = "bucket int, block string, n bigint, own binary, strings binary, lengths binary"
_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("n", pa.int64()), ("own", pa.binary()), ("strings", pa.binary()), ("lengths", pa.binary())])


def _words(strings: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths)
    return [strings[e - n: e] for e, n in zip(ends.tolist(), lengths.tolist())]


def _hashed(words: list[bytes]) -> np.ndarray:
    """Hashes of words, none of which holds a separator."""
    return np.concatenate([np.zeros(0, U), *(p.hashes for p in words_of(pa.array([b" ".join(words)], pa.binary()).cast(pa.large_string()), PLAIN, lower=False))])


def _ask(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket: distinct words and their places in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = unpack_numbers(row["lengths"], row["n_words"]).astype(np.int64)
                words = _words(pa.decompress(row["strings"], int(lengths.sum()), "zstd", asbytes=True) if len(lengths) else b"", lengths)
                bucket = (mix(_hashed(words)) % U(buckets)).astype(np.int64)
                out = []
                for b in range(buckets):
                    own = np.flatnonzero(bucket == b)
                    if len(own):
                        joined = b"".join([words[i] for i in own.tolist()])
                        out.append({"bucket": b, "block": row["block"], "n": len(own), "own": pack_numbers(np.diff(own, prepend=0)),
                                    "strings": pa.compress(joined, "zstd", asbytes=True), "lengths": pack_numbers(lengths[own])})
                yield pa.RecordBatch.from_pylist(out, schema=_ASK)

    return blocks.select("block", "n_words", "strings", "lengths").mapInArrow(run, _ASK_DDL)


def token_counts(docs: DataFrame, *, text: str = "text", columns: Sequence[str] | None = None, vocabulary: str = VOCABULARY,
                 block_words: int = BLOCK_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """The given columns (all by default) plus n_words and n_tokens of each whole text.

    Null and empty texts have none. Any bytes are covered, so every text has a count. Repeated
    rows each get theirs. Columns named like an output are replaced. No rows in, no rows out. The
    vocabulary is read on the driver; its size is that of the file.
    """
    tables = Tables(docs.sparkSession, "trie")
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in OUTPUT]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.lit(False).alias("held"), F.col(text).alias("text"))
    row_type = packed.schema["row"].dataType
    blocks = tables.write(text_blocks(packed, block_words, lower=False, strings=True))
    asked = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(asked / bucket_words))
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(read_pieces(vocabulary)))

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = []
        for r in rows:
            lengths = unpack_numbers(r["lengths"], r["n"]).astype(np.int64)
            words += _words(pa.decompress(r["strings"], int(lengths.sum()), "zstd", asbytes=True), lengths)
        _, first, place = np.unique(_hashed(words), return_index=True, return_inverse=True)
        counts = count_words([words[i] for i in first.tolist()], shared.value)[place]
        to = np.cumsum([r["n"] for r in rows])
        return pa.table({"block": table["block"], "own": table["own"], "n": table["n"],
                         "counts": pa.array([pack_numbers(counts[e - r["n"]: e]) for r, e in zip(rows, to)], pa.binary())})

    counted = tables.write(_ask(blocks, buckets).groupBy("bucket").applyInArrow(answer, "block string, own binary, n bigint, counts binary"))
    joined = blocks.select("block", "rows", "counts", "words", "n_words", "ids").join(
        counted.groupBy("block").agg(F.collect_list(F.struct("own", "n", "counts")).alias("answers")), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i] for c in ("counts", "words", "n_words", "ids", "answers")}
                counts = np.frombuffer(one["counts"].as_py(), np.int64)
                of_word = np.zeros(one["n_words"].as_py(), np.int64)
                for a in one["answers"].as_py() or ():
                    of_word[np.cumsum(unpack_numbers(a["own"], a["n"]))] = unpack_numbers(a["counts"], a["n"])
                ids = unpack_numbers(one["ids"].as_py(), one["words"].as_py())
                sums = np.concatenate(([0], np.cumsum(of_word[ids])))
                bounds = np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays([batch.column("rows")[i].values, pa.array(counts), pa.array(sums[bounds[1:]] - sums[bounds[:-1]])],
                                                 ["row", *OUTPUT])

    schema = T.StructType([T.StructField("row", row_type), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return joined.mapInArrow(run, schema).select("row.*", *OUTPUT)
