"""Katz backoff language model with Good-Turing discounts, built and evaluated over blocks of texts.

    P(w | h) = d(c(h w)) * c(h w) / c(h)       if h w was seen in training
             = a(h) * P(w | h without its first word)  otherwise,

down to single words, where what the discounts leave goes to one class of unseen words. d is
Good-Turing's discount for counts up to `k` (absolute discounting where the counts of counts do
not allow it), and a(h) makes the probabilities after every h add up to 1 exactly. A history all
of whose continuations are too frequent to be discounted counts one more event.

Texts are cut into blocks. For each order, a block asks the partitions of the count table for
its own n-grams, each once, with its training counts; a partition (all n-grams of some
histories) adds up what all blocks send, stores its part of the table, and answers each block
with the counts of its n-grams and the sums over its histories that the backoff weight needs.
The next order starts from these answers. Frequent histories are split over several partitions
by the next word, and their sums are added up in the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import pack, pack_numbers, text_blocks, unpack, unpack_numbers
from .scratch import Tables
from .tokens import U, join_hash, mix

ORDER, K = 2, 5
BLOCK_WORDS, BUCKET_GRAMS = 1_000_000, 1_000_000
START, END = U(0xFFFFFFFFFFFFFFFF), U(0x454E44)
OUTPUT = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def discounts(seen: Sequence[int], k: int = K) -> np.ndarray:
    """d(0), ..., d(k) from the numbers of n-grams seen 0, 1, ..., k + 1 times (place 0 is not used)."""
    n = [float(x) for x in seen]
    d = np.ones(k + 1)
    if all(n[1: k + 2]):
        common = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else 0
        if all(0 < x < 1 for x in d[1:]):
            return d
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.array([1.0] + [(r - off) / r for r in range(1, k + 1)])


class Level:
    """What holds for one order: discounts and totals."""

    def __init__(self, seen: Sequence[int], total: int, types: int, k: int = K):
        self.d, self.total, self.types, self.k = discounts(seen, k), total, types, k
        self.left = float(sum((1 - self.d[r]) * r * seen[r] for r in range(1, k + 1)))

    def unseen(self) -> float:
        """Share of the unseen class among single words."""
        return 1.0 if not self.total else self.left / self.total if self.left > 0 else 1 / (self.total + 1)

    def single(self, counts: np.ndarray) -> np.ndarray:
        """Probability of single words from their training counts."""
        if not self.total:
            return np.ones(len(counts))
        total = self.total if self.left > 0 else self.total + 1
        d = np.where(counts <= self.k, self.d[np.minimum(counts, self.k)], 1.0)
        return np.where(counts > 0, d * counts / total, self.unseen())

    def seen(self, counts: np.ndarray, history: np.ndarray, few: np.ndarray, lower: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probability after a history: few[r - 1] continuations were seen r times, below is the sum of their lower probabilities."""
        left = sum((1 - self.d[r]) * r * few[r - 1] for r in range(1, self.k + 1))
        total = np.where(left > 0, history, history + 1)
        share = np.where(left > 0, left, 1.0) / np.maximum(total, 1)
        weight = np.where(history > 0, share / np.maximum(1 - below, 1e-300), 1.0)
        d = np.where(counts <= self.k, self.d[np.minimum(counts, self.k)], 1.0)
        return np.where(counts > 0, d * counts / np.maximum(total, 1), weight * lower)


class Block:
    """The token stream of a block, and the n-grams in it."""

    def __init__(self, row: dict):
        counts = np.frombuffer(row["counts"], np.int64)
        held = np.frombuffer(row["held"], bool)
        self.n_vocab = row["n_words"] + 1
        # words of a block are numbered by frequency; the end token comes last
        self.vocab = np.append(np.frombuffer(row["vocab"], U), END) if "vocab" in row else None
        ids = unpack_numbers(row["ids"], row["words"])
        self.n_tokens = counts + 1
        self.text = np.repeat(np.arange(len(counts), dtype=np.int32), self.n_tokens)
        self.place = np.arange(len(self.text)) - np.repeat(np.cumsum(self.n_tokens) - self.n_tokens, self.n_tokens)
        ends = np.cumsum(self.n_tokens) - 1
        number = np.full(len(self.text), self.n_vocab - 1, np.int32)
        inner = np.ones(len(self.text), bool)
        inner[ends] = False
        number[inner] = ids
        self.number = number
        self.train = ~held[self.text]
        self.held = held

    def history(self, order: int) -> np.ndarray:
        """Hash of the order - 1 tokens before each token; START stands before a text."""
        out = None
        for back in range(1, order):
            before = np.full(len(self.word), START, U)
            before[back:] = self.word[: len(self.word) - back]
            before[self.place < back] = START
            out = before if out is None else join_hash(before, out)
        return out


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of so many equal ranges of keys begins among sorted keys, and the end."""
    starts = np.arange(1, buckets, dtype=U) * U(((1 << 64) - 1) // buckets)
    return np.concatenate(([0], np.searchsorted(keys, starts), [len(keys)])).astype(np.int64)


class Grams:
    """The distinct n-grams of a block in the order in which they are asked for."""

    def __init__(self, block: Block, order: int, history_count: np.ndarray, bucket_grams: int):
        """history_count: training events after each token's history, as far as known."""
        history, split = block.history(order), 1 + (history_count // bucket_grams).astype(np.int64)
        word = block.word
        salt = (word % split.astype(U)).astype(U)
        self.key = self._key(history, salt)
        frequent = split > 1
        hot = np.unique(np.stack([history[frequent], split[frequent].astype(U)]), axis=1) if frequent.any() else np.zeros((2, 0), U)
        extra = [self._key(np.full(int(s), h, U), np.arange(int(s), dtype=U)) for h, s in hot.T]
        n, virtual = len(self.key), np.concatenate([np.zeros(0, U), *extra])
        keys, words = np.concatenate([self.key, virtual]), np.concatenate([word, np.zeros(len(virtual), U)])
        sorting = np.lexsort((words, keys))
        keys, words = keys[sorting], words[sorting]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (words[1:] != words[:-1])
        group = np.cumsum(first) - 1
        self.gram_of = np.empty(len(keys), np.int64)
        self.gram_of[sorting] = group
        self.gram_of = self.gram_of[:n]
        self.keys, self.words = keys[first], words[first]
        self.counts = np.bincount(self.gram_of, block.train, len(self.keys)).astype(np.int64)
        new = np.ones(len(self.keys), bool)
        new[1:] = self.keys[1:] != self.keys[:-1]
        self.own_keys = self.keys[new]
        self.split, self.history, self.hot = split, history, hot

    @staticmethod
    def _key(history: np.ndarray, salt: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(mix(history) + salt * U(0x9E3779B97F4A7C15))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per token: the sum of a history's values over all its parts; values has a row per own key."""
        at = np.searchsorted(self.own_keys, self.key)
        out = values[at]
        for h, s in self.hot.T:
            parts = np.searchsorted(self.own_keys, self._key(np.full(int(s), h, U), np.arange(int(s), dtype=U)))
            out[self.history == h] = values[parts].sum(axis=0)
        return out


def _schema(ddl: str) -> pa.Schema:
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, types[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


# n n-grams of n_keys histories: lengths says how many of each, words their last words' numbers
_ASK_DDL = ("bucket int, block string, own binary, n bigint, n_keys bigint, keys binary, lengths binary, words binary, codes binary, n_lower bigint, lower binary, "
            "counts binary")
_ANSWER_DDL = ("kind string, level int, bucket int, block string, own binary, n bigint, n_keys bigint, keys binary, lengths binary, words binary, counts binary, "
               "ranks binary, sums binary, seen array<bigint>")
_ASK, _ANSWER = _schema(_ASK_DDL), _schema(_ANSWER_DDL)


def _grams_packed(keys: np.ndarray, words: np.ndarray) -> dict:
    """n-grams sorted by key as columns."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return {"n": len(keys), "n_keys": len(first), "keys": pack_numbers(np.diff(keys[first], prepend=U(0))), "words": pack_numbers(words),
            "lengths": pack_numbers(np.diff(np.append(first, len(keys))))}


def _counted(counts: np.ndarray, k: int) -> list[int]:
    """How many were seen 0, 1, ..., k + 1 times, then tokens and types."""
    return [0, *(int((counts == r).sum()) for r in range(1, k + 2)), int(counts.sum()), int((counts > 0).sum())]


def _ask_words(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                counts = np.bincount(block.number, block.train, block.n_vocab).astype(np.int64)
                order = np.argsort(mix(block.vocab))
                edges = _bounds(mix(block.vocab)[order], buckets)
                parts = [(b, np.sort(order[edges[b]: edges[b + 1]])) for b in range(buckets)]
                yield pa.RecordBatch.from_pylist([
                    {"bucket": b, "block": row["block"], "n": len(own), "own": pack_numbers(np.diff(own, prepend=0)),
                     "words": block.vocab[own].tobytes(), "counts": pack_numbers(counts[own])}
                    for b, own in parts if len(own)], schema=_ASK)

    return blocks.mapInArrow(run, _ASK_DDL)


def _answer_words(table: pa.Table, k: int) -> pa.Table:
    rows = table.to_pylist()
    asked = [np.frombuffer(r["words"], U) for r in rows]
    values, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(place, np.concatenate([unpack_numbers(r["counts"], r["n"]) for r in rows]), len(values)).astype(np.int64)
    ends = np.cumsum([len(a) for a in asked])
    out = [{"kind": "answer", "level": 1, "bucket": r["bucket"], "block": r["block"], "n": r["n"], "own": r["own"], "counts": pack_numbers(total[place[e - r["n"]: e]]),
            "ranks": pack_numbers(place[e - r["n"]: e])} for r, e in zip(rows, ends)]
    known = total > 0
    out.append({"kind": "model", "level": 1, "bucket": rows[0]["bucket"], "n": int(known.sum()), "words": values[known].tobytes(),
                "counts": pack_numbers(total[known]), "seen": _counted(total, k)})
    return pa.Table.from_pylist(out, schema=_ANSWER)


def _ask_grams(joined: DataFrame, order: int, levels: list[Level], buckets: int, bucket_grams: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                lower, history = _evaluate(block, row["answers"], levels, buckets, bucket_grams)
                grams = Grams(block, order, history, bucket_grams)
                of_gram = np.zeros(len(grams.keys))
                of_gram[grams.gram_of] = lower
                edges = _bounds(grams.keys, buckets)
                out = []
                for b in range(buckets):
                    part = slice(int(edges[b]), int(edges[b + 1]))
                    if part.stop == part.start:
                        continue
                    values, codes = np.unique(of_gram[part], return_inverse=True)
                    out.append({"bucket": b, "block": row["block"], **_grams_packed(grams.keys[part], grams.words[part]),
                                "codes": pack_numbers(codes), "n_lower": len(values), "lower": pack_numbers(values.view(U)), "counts": pack_numbers(grams.counts[part])})
                yield pa.RecordBatch.from_pylist(out, schema=_ASK)

    return joined.mapInArrow(run, _ASK_DDL)


def _answer_grams(table: pa.Table, order: int, k: int) -> pa.Table:
    rows = table.to_pylist()
    keys, words, lower, counts, own = [], [], [], [], []
    for r in rows:
        own.append(np.cumsum(unpack_numbers(r["keys"], r["n_keys"]), dtype=U))
        keys.append(np.repeat(own[-1], unpack_numbers(r["lengths"], r["n_keys"]).astype(np.int64)))
        words.append(unpack_numbers(r["words"], r["n"]))
        lower.append(unpack_numbers(r["lower"], r["n_lower"]).view(np.float64)[unpack_numbers(r["codes"], r["n"])])
        counts.append(unpack_numbers(r["counts"], r["n"]))
    keys, words, lower, counts = map(np.concatenate, (keys, words, lower, counts))
    sorting = np.lexsort((words, keys))
    sorted_keys, sorted_words = keys[sorting], words[sorting]
    first = np.ones(len(keys), bool)
    first[1:] = (sorted_keys[1:] != sorted_keys[:-1]) | (sorted_words[1:] != sorted_words[:-1])
    group = np.cumsum(first) - 1
    place = np.empty(len(keys), np.int64)
    place[sorting] = group
    total = np.bincount(place, counts, group[-1] + 1).astype(np.int64)
    gram_key, gram_word, gram_lower = sorted_keys[first], sorted_words[first], lower[sorting][first]
    every, of = np.unique(gram_key, return_inverse=True)
    sums = np.stack([np.bincount(of, total, len(every)),
                     *(np.bincount(of, total == r, len(every)) for r in range(1, k + 1)),
                     np.bincount(of, np.where(total > 0, gram_lower, 0), len(every))])
    ends, out = np.cumsum([r["n"] for r in rows]), []
    for r, e, mine in zip(rows, ends, own):
        at = np.searchsorted(every, mine)
        out.append({"kind": "answer", "level": order, "bucket": r["bucket"], "block": r["block"], "n": r["n"], "n_keys": r["n_keys"],
                    "counts": pack_numbers(total[place[e - r["n"]: e]]), "sums": pack(np.ascontiguousarray(sums[:, at]))})
    known = total > 0
    packed = _grams_packed(gram_key[known], gram_word[known])
    used = np.unique(gram_key[known])
    out.append({"kind": "model", "level": order, "bucket": rows[0]["bucket"], **packed, "counts": pack_numbers(total[known]),
                "sums": pack(np.ascontiguousarray(sums[:, np.searchsorted(every, used)])), "seen": _counted(total, k)})
    return pa.Table.from_pylist(out, schema=_ANSWER)


def _answering(order: int, k: int):
    return lambda table: _answer_grams(table, order, k)


def _evaluate(block: Block, answers: list[dict], levels: list[Level], buckets: int, bucket_grams: int) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token by the given levels, and training events after the next longer history."""
    by_level: dict[int, list[dict]] = {}
    for a in answers:
        by_level.setdefault(a["level"], []).append(a)
    parts = sorted(by_level[1], key=lambda a: a["bucket"])
    # a word's number in all blocks: its place in its bucket, then the bucket
    counts, numbers = np.zeros(block.n_vocab, np.int64), np.zeros(block.n_vocab, U)
    for a in parts:
        own = np.cumsum(unpack_numbers(a["own"], a["n"]).astype(np.int64))
        counts[own] = unpack_numbers(a["counts"], a["n"])
        numbers[own] = unpack_numbers(a["ranks"], a["n"]) * U(buckets) + U(a["bucket"] + 1)
    block.word = numbers[block.number]
    block.known = counts[block.number]
    probability = levels[0].single(block.known)
    # a text's first token comes after START, met once per text: unknown here, never over any limit of one block
    history = np.zeros(len(block.number), np.int64)
    history[1:] = block.known[:-1]
    history[block.place == 0] = levels[0].starts
    for order, level in enumerate(levels[1:], 2):
        grams = Grams(block, order, history, bucket_grams)
        parts = sorted(by_level[order], key=lambda a: a["bucket"])
        own = np.concatenate([unpack_numbers(a["counts"], a["n"]).astype(np.int64) for a in parts])[grams.gram_of]
        sums = np.concatenate([unpack(a["sums"], np.float64, a["n_keys"] * (level.k + 2)).reshape(level.k + 2, -1) for a in parts], axis=1)
        sums = grams.sums(np.ascontiguousarray(sums.T)).T
        probability = level.seen(own, sums[0], sums[1: level.k + 1], probability, sums[level.k + 1])
        # events after the history that ends with this token, for the next order
        history = np.zeros(len(block.number), np.int64)
        history[1:] = own[:-1]
        history[block.place == 0] = levels[0].starts
    return probability, history


def score_texts(docs: DataFrame, held_out: Column, *, text: str = "text", columns: Sequence[str] | None = None, order: int = ORDER, k: int = K,
                block_words: int = BLOCK_WORDS, bucket_grams: int = BUCKET_GRAMS, tables: Tables | None = None) -> DataFrame:
    """Learn from rows where `held_out` is false and score all; adds held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are runs without white space, A-Z lowered; each text ends with an end token. Null and
    empty texts are that token alone. A null `held_out` counts as true. Scores are log10
    probabilities and always finite: unseen words have the share that discounting leaves, all of it
    if there are no training texts. Repeated rows count each time. Columns named like an output
    are replaced. No rows in, no rows out. The count tables are left in the shared folder,
    partitioned by kind ("model") with level and bucket.
    """
    tables = tables or Tables(docs.sparkSession, "katz")
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in OUTPUT]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(held_out, F.lit(True)).alias("held"), F.col(text).alias("text"))
    row_type = packed.schema["row"].dataType
    blocks = tables.write(text_blocks(packed, block_words))
    words, texts = blocks.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum(F.size("rows")), F.lit(0))).first()
    buckets = max(1, math.ceil((words + texts) / bucket_grams))

    def stored(answers: DataFrame, level: int) -> tuple[DataFrame, Level]:
        table = tables.write(answers, partition_by="kind")
        seen = [int(x or 0) for x in table.filter("kind = 'model'").agg(*[F.sum(F.col("seen")[i]) for i in range(k + 4)]).first()]
        return table.filter("kind = 'answer'").select("level", "bucket", "block", "own", "n", "n_keys", "counts", "ranks", "sums"), Level(seen[: k + 2], seen[k + 2], seen[k + 3], k)

    answers, level = stored(_ask_words(blocks, buckets).groupBy("bucket").applyInArrow(lambda t: _answer_words(t, k), _ANSWER_DDL), 1)
    level.starts = texts
    levels = [level]
    part = F.struct("level", "bucket", "own", "n", "n_keys", "counts", "ranks", "sums")
    joined, none = blocks.drop("strings", "lengths"), F.array().cast("array<struct<level:int,bucket:int,own:binary,n:bigint,n_keys:bigint,counts:binary,ranks:binary,sums:binary>>")

    def answered(joined: DataFrame, answers: DataFrame) -> DataFrame:
        """Blocks with the answers so far."""
        earlier = F.col("answers") if "answers" in joined.columns else none
        return joined.withColumn("earlier", earlier).drop("answers", "vocab").join(
            answers.groupBy("block").agg(F.collect_list(part).alias("now")), "block").withColumn("answers", F.concat("earlier", "now")).drop("earlier", "now")

    for n in range(2, order + 1):
        # written, so that the shuffle of the blocks has gone before the n-grams are sent
        joined = tables.write(answered(joined, answers))
        tables.remove(blocks)
        blocks = joined
        asked = _ask_grams(joined, n, levels, buckets, bucket_grams)
        answers, level = stored(asked.groupBy("bucket").applyInArrow(_answering(n, k), _ANSWER_DDL), n)
        levels = [*levels, level]
    joined = answered(joined, answers)
    total, types = levels[0].total, levels[0].types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                block = Block({c: one.column(c)[0].as_py() for c in ("counts", "held", "ids", "words", "n_words")})
                probability, _ = _evaluate(block, one.column("answers")[0].as_py(), levels, buckets, bucket_grams)
                n = len(block.n_tokens)
                add = lambda values: np.bincount(block.text, values, n)
                base = np.log10((block.known + 0.1) / (total + 0.1 * (types + 1)))
                rows = one.column("rows")[0].values
                yield pa.RecordBatch.from_arrays([
                    rows, pa.array(block.held), pa.array(block.n_tokens), pa.array(add(block.known > 0).astype(np.int64)),
                    pa.array(np.full(n, total, np.int64)), pa.array(add(base)), pa.array(add(np.log10(probability)))],
                    ["row", *OUTPUT])

    schema = T.StructType([T.StructField("row", row_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return joined.mapInArrow(run, schema).select("row.*", *OUTPUT)
