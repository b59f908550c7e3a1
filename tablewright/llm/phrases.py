"""Collocations by Toivonen's sampling: phrases found frequent in a sample and their border, counted exactly.

1. Texts are written once as blocks of word numbers of one language, with a mark between pieces. Every
   sixteenth text of a task goes to sample blocks.
2. The sample proposes phrases: those that occur there at a lowered threshold, two standard
   deviations below what a phrase at the threshold would show.
3. A full pass over all blocks counts, exactly, every proposed phrase and the negative border: every
   phrase, proposed or not, both of whose parts with one word less are proposed (all single
   words are). Membership is a filter of bounded size, shared with the tasks; a phrase let
   through wrongly is only counted as well.
4. A counted phrase that reaches the threshold without having been proposed is a failure of the
   border: its extensions may be frequent, too. While there are such phrases, the next pass counts those of
   their extensions that no pass has counted, both of whose parts are frequent. What has no such part
   was counted before; so after the last pass every phrase of frequent parts has been counted.
5. Each frequent phrase carries the place of one occurrence, from a block chosen by its hash, so that
   the words are looked up once, in one block. Cuts are joined with the counts of their parts.

Phrases are compared by 64-bit hashes of their lower-cased words and language.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import pack, pack_numbers, unpack, unpack_numbers
from .scratch import Tables
from .tokens import U, join_hash, word_bytes, words_of

LONGEST, LEAST, FIRST = 5, 100, 2000
SAMPLE = 16               #: every so manieth text
BLOCK_WORDS = 1_000_000
FILTER_BITS = 1 << 29     #: largest filter: 64 MB, whatever the number of phrases
BITS_EACH = 16            #: of the filter, for each phrase, as long as it is not the largest
UNKNOWN = "und"

BREAKS = ".,;:!?\n\x0b\x0c\r"
WORD = word_bytes(" \t" + BREAKS)
_BREAK = ~word_bytes(BREAKS)
_PLACE_BITS, _SIZE_BITS = 27, 3  #: of a place: word in the block, words of the phrase; the rest names the block
_BLOCK_MASK = (1 << 32) - 1


def phrase_blocks(docs: DataFrame, block_words: int, sample: int) -> DataFrame:
    """docs: lang, text -> number, lang, sampled, n (words and marks), words, ids, vocab, strings, lengths.

    ids are numbers of words from 1 on; 0 stands between pieces.
    """

    def flush(number: int, lang: str, sampled: bool, parts: list) -> pa.RecordBatch:
        hashes = np.concatenate([h for h, _, _ in parts])
        vocab, ids = np.unique(hashes, return_inverse=True)
        texts: dict[int, bytes] = {}
        for _, _, own in parts:
            texts.update(own)
        strings = [texts[h] for h in vocab.tolist()]
        # where a piece begins, a mark goes before its first word
        begins = np.concatenate([b for _, b, _ in parts])
        marked = np.zeros(len(ids) + int(begins.sum()), np.int64)
        marked[np.arange(len(ids)) + np.cumsum(begins)] = ids + 1
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([lang]), pa.array([sampled]), pa.array([len(marked)], pa.int64()), pa.array([len(ids)], pa.int64()),
            pa.array([pack_numbers(marked)], pa.binary()), pa.array([pack(vocab)], pa.binary()),
            pa.array([pa.compress(b"".join(strings), "zstd", asbytes=True)], pa.binary()),
            pa.array([pack_numbers(np.array([len(s) for s in strings], np.int64))], pa.binary())],
            ["number", "lang", "sampled", "n", "words", "ids", "vocab", "strings", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[str, bool], list] = defaultdict(list)
        total, text, number = 0, 0, TaskContext.get().partitionId() << 12
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part in words_of(batch.column(1), WORD):
                bounds, n = part.bounds, len(part.hashes)
                breaks = np.concatenate(([0], np.cumsum(_BREAK[part.data])))
                begins = np.ones(n, bool)
                if n > 1:
                    begins[1:] = breaks[part.starts[1:]] > breaks[part.ends[:-1]]
                begins[bounds[:-1][part.counts > 0]] = True
                groups = defaultdict(list)
                for i in range(len(part.counts)):
                    if part.counts[i]:
                        groups[langs[part.first + i], (text + i) % sample == 0].append(i)
                text += len(part.counts)
                for key, own in groups.items():
                    at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in own])
                    new, first = np.unique(part.hashes[at], return_index=True)
                    waiting[key].append((part.hashes[at], begins[at], dict(zip(new.tolist(), part.strings(at[first])))))
                total += n
                # more words to a block in a very long task: block numbers have 12 bits beside the task's
                if total >= block_words * (1 + (number & 4095) // 1024):
                    for (lang, sampled), parts in waiting.items():
                        yield flush(number, lang, sampled, parts)
                        number += 1
                    waiting.clear()
                    total = 0
        for (lang, sampled), parts in waiting.items():
            yield flush(number, lang, sampled, parts)
            number += 1

    return docs.mapInArrow(run, "number bigint, lang string, sampled boolean, n bigint, words bigint, ids binary, vocab binary, strings binary, lengths binary")


def _hashes(row: dict) -> np.ndarray:
    """One hash per word, of the language and the word; 0 for marks."""
    ids = unpack_numbers(row["ids"], row["n"])
    vocab = unpack(row["vocab"], U, int(ids.max(initial=0)))
    seed = np.frombuffer(hashlib.blake2b(row["lang"].encode(), digest_size=8).digest(), U)
    return np.concatenate((np.zeros(1, U), join_hash(np.repeat(seed, len(vocab)), vocab)))[ids]


def _longer(grams: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` words from each place on, from those of one word less; 0 where they cross a mark."""
    left, right = grams[: len(grams) - 1], words[size - 1:]
    return np.where((left != 0) & (right != 0), join_hash(left, right), U(0))


class Filter:
    """A set of hashes; never says no wrongly. Two bits each, in words of 64."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = U(len(words) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in places(hashes, self.mask):
            found &= (self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) != 0
        return found


def places(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return hashes & mask, (hashes >> U(32)) & mask


def _filter(phrases: DataFrame, count: int) -> Filter:
    """phrases: key. The words of the filter are put together by Spark; their number is bounded."""
    bits = 1 << max(12, min(FILTER_BITS.bit_length() - 1, (BITS_EACH * max(1, count) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(U)
            at = np.concatenate(places(own, U(bits - 1)))
            order = np.argsort(at >> U(6), kind="stable")
            word = (at[order] >> U(6)).astype(np.int64)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            values = np.bitwise_or.reduceat(U(1) << (at[order] & U(63)), first) if len(word) else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(values.view(np.int64))], ["word", "bits"])

    found = phrases.select("key").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, U)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(U)
    return Filter(words)


def _per_block(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the first ones, distinct hashes, counts) of those that are not 0."""
    at = np.flatnonzero(hashes)
    order = at[np.argsort(hashes[at], kind="stable")]
    own = hashes[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return order[first], own[first], np.diff(np.append(first, len(own)))


def _sampled(blocks: DataFrame, longest: int) -> DataFrame:
    """lang, size, key, n: all phrases of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = grams = _hashes(row)
                for size in range(1, longest + 1):
                    grams = words if size == 1 else _longer(grams, words, size)
                    _, keys, counts = _per_block(grams)
                    yield pa.RecordBatch.from_arrays([pa.repeat(row["lang"], len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)],
                                                     ["lang", "key", "n"])

    return blocks.select("lang", "n", "ids", "vocab").mapInArrow(run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _counted(blocks: DataFrame, filters: list, longest: int) -> DataFrame:
    """key, n, place of the phrases that the last pass lets in and none before did.

    A pass is a filter of phrases and, after the first pass, one of those new in it. It lets in a phrase both of
    whose parts are in the filter and, after the first pass, one of them new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = [(Filter(own.value), new and Filter(new.value)) for own, new in filters]
        last, new = passes[-1]
        for batch in batches:
            for row in batch.to_pylist():
                words = grams = _hashes(row)
                known = np.zeros(0, bool)
                for size in range(1, longest + 1):
                    if size == 1:
                        wanted = words if new is None else np.zeros(0, U)
                    else:
                        parts, grams = grams, _longer(grams, words, size)
                        let = known[: len(grams)] & known[1: len(grams) + 1] if new is None else known[: len(grams)] | known[1: len(grams) + 1]
                        if new is None:
                            wanted = np.where(let, grams, U(0))
                            if not let.any():
                                break
                        else:  # few places: only there the other filters are asked
                            at = np.flatnonzero(let & (grams != 0))
                            at = at[last.has(parts[at]) & last.has(parts[at + 1])]
                            for earlier, fresh in passes[:-1]:
                                left, right = parts[at], parts[at + 1]
                                held = earlier.has(left) & earlier.has(right)
                                at = at[~(held if fresh is None else held & (fresh.has(left) | fresh.has(right)))]
                            wanted = np.zeros(len(grams), U)
                            wanted[at] = grams[at]
                    if size < longest:
                        known = (last if new is None else new).has(grams) & (grams != 0)
                    first, keys, counts = _per_block(wanted)
                    block = (U(row["number"]) ^ keys) & U(_BLOCK_MASK)  # of several blocks, the hash decides which one is least
                    at = (block << U(_PLACE_BITS + _SIZE_BITS)) | (first.astype(U) << U(_SIZE_BITS)) | U(size)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts), pa.array(at.view(np.int64))], ["key", "n", "place"])

    return blocks.select("number", "lang", "n", "ids", "vocab").mapInArrow(run, "key bigint, n bigint, place bigint").groupBy("key").agg(
        F.sum("n").alias("n"), F.min("place").alias("place"))


def _outside(phrases: DataFrame, last: tuple, longest: int) -> DataFrame:
    """Phrases that can be extended and whose extensions the last pass did not let in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(f.value) for f in last if f is not None]
        for batch in batches:
            keys = batch.column(0).to_numpy().view(U)
            inside = np.ones(len(keys), bool)
            for own in filters:
                inside &= own.has(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[~inside].view(np.int64))], ["key"])

    return phrases.filter(F.col("place").bitwiseAND((1 << _SIZE_BITS) - 1) < longest).select("key").mapInArrow(run, "key bigint")


def _spelled(blocks: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, size, phrase, key, a, and the keys of both parts of each cut; every phrase is looked up in one block."""
    block = F.shiftrightunsigned("place", _PLACE_BITS + _SIZE_BITS).bitwiseXOR(F.col("key").bitwiseAND(_BLOCK_MASK))
    asked = phrases.select(block.alias("number"), "key", "n", F.shiftrightunsigned("place", _SIZE_BITS).bitwiseAND((1 << _PLACE_BITS) - 1).alias("at"),
                           F.col("place").bitwiseAND((1 << _SIZE_BITS) - 1).cast("int").alias("size"))
    schema = "lang string, size int, phrase string, key bigint, a bigint, lefts array<bigint>, rights array<bigint>"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], t) for n, t in (("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("key", pa.int64()),
                                                             ("a", pa.int64()), ("lefts", pa.list_(pa.int64())), ("rights", pa.list_(pa.int64())))})
        row = left.to_pylist()[0]
        words = _hashes(row)
        ids = unpack_numbers(row["ids"], row["n"]).astype(np.int64)
        lengths = unpack_numbers(row["lengths"], int(ids.max(initial=0))).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        strings = pa.decompress(row["strings"], int(ends[-1]), "zstd", asbytes=True)
        at, size = right["at"].to_numpy(), right["size"].to_numpy()
        # parts[i][j]: the j + 1 words from the i-th one on
        longest = int(size.max())
        parts = []
        for i in range(longest):
            own = [words[np.minimum(at + i, len(words) - 1)]]
            for j in range(1, longest - i):
                own.append(join_hash(own[-1], words[np.minimum(at + i + j, len(words) - 1)]))
            parts.append(own)
        lefts, rights, texts = [], [], []
        for k, (a, n) in enumerate(zip(at.tolist(), size.tolist())):
            texts.append(b" ".join([strings[ends[w - 1]: ends[w]] for w in ids[a: a + n].tolist()]).decode())
            lefts.append([int(parts[0][j][k].view(np.int64)) for j in range(n - 1)])
            rights.append([int(parts[j + 1][n - 2 - j][k].view(np.int64)) for j in range(n - 1)])
        return pa.table({"lang": pa.array([row["lang"]] * len(at)), "size": pa.array(size, pa.int32()), "phrase": pa.array(texts), "key": right["key"],
                         "a": right["n"], "lefts": pa.array(lefts, pa.list_(pa.int64())), "rights": pa.array(rights, pa.list_(pa.int64()))})

    return blocks.groupBy("number").cogroup(asked.groupBy("number")).applyInArrow(run, schema)


def _proposed(blocks: DataFrame, tables: Tables, longest: int, least: int) -> DataFrame:
    """Keys frequent in the sample, at a threshold per language."""
    words = blocks.groupBy("lang").agg(F.sum("words").alias("all"), F.sum(F.when(F.col("sampled"), F.col("words")).otherwise(0)).alias("own"))
    expected = F.lit(float(least)) * F.col("own") / F.col("all")
    floor = words.select("lang", F.greatest(F.lit(2), F.floor(expected - 2 * F.sqrt(expected))).alias("floor"))
    return tables.write(_sampled(blocks.filter("sampled"), longest).join(floor, "lang").filter("n >= floor").select("key"))


def frequent_phrases(docs: DataFrame, tables: Tables, *, lang: str, text: str, longest: int, least: int, block_words: int,
                     sample: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, phrases): key, n, place of every phrase of up to `longest` words that occurs `least` times in its language."""
    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks = tables.write(phrase_blocks(own, block_words, sample))
    context = docs.sparkSession.sparkContext
    own, new, filters, found = _proposed(blocks, tables, longest, least), None, [], None
    while True:  # at most one pass for each length, and one more
        filters.append(tuple(None if f is None else context.broadcast(_filter(f, f.count()).words) for f in (own, new)))  # bounded: FILTER_BITS
        passed = tables.write(_counted(blocks, filters, longest).filter(F.col("n") >= least))
        found = passed if found is None else found.unionByName(passed)
        # failures of the border: frequent, and what extends them was not counted
        failed = tables.write(_outside(passed, filters[-1], longest))
        if failed.isEmpty():
            return blocks, found
        own, new = tables.write(failed.unionByName(found.select("key"))), failed


def mine_phrases(docs: DataFrame, *, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, first: int = FIRST,
                 percent: int = 100, block_words: int = BLOCK_WORDS, sample: int = SAMPLE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `first` best phrases.

    Words are lower-cased (A-Z), end at spaces and tabs, and phrases of 2 to `longest` words do not cross
    `.,;:!?` or line ends. A phrase occurring a >= `least` times scores floor(1000 * a * n / (l * r))
    at its worst cut, of equal ones the first; n counts the language's words, l and r the cut's parts.
    A phrase is left out if a longer one that holds it occurs 100 * f >= `percent` * a times. Ties go to the
    larger a, then to the phrase first in byte order. A null language counts as `und`; null and empty texts
    have no words; repeated rows count each time; a very long text is one block. No rows in, no rows out;
    other columns are not looked at.
    """
    tables = Tables(docs.sparkSession, "phrases")
    blocks, found = frequent_phrases(docs, tables, lang=lang, text=text, longest=longest, least=least, block_words=block_words, sample=sample)
    words = blocks.groupBy("lang").agg(F.sum("words").alias("n"))
    known = tables.write(_spelled(blocks, found))
    counts = known.select("key", "a")
    candidates = known.filter("size > 1")
    # whatever holds a phrase holds it in one word more, at least as often
    part = F.explode(F.array(F.element_at("lefts", -1), F.element_at("rights", 1)))
    longer = known.filter("size > 2").select(part.alias("key"), F.col("a").alias("f")).groupBy("key").agg(F.max("f").alias("f"))
    kept = candidates.join(longer, "key", "left").filter(F.col("f").isNull() | (F.col("f") * 100 < F.col("a") * percent)).drop("f")
    cuts = kept.select("lang", "key", "phrase", "a", F.posexplode(F.arrays_zip("lefts", "rights")).alias("cut", "parts")).select(
        "lang", "key", "phrase", "a", "cut", F.col("parts.lefts").alias("left"), F.col("parts.rights").alias("right"))
    scored = (cuts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left")
              .join(counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
              .join(F.broadcast(words) if words.count() <= 10_000 else words, "lang")
              .withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")))
    worst = scored.groupBy("key").agg(F.min(F.struct("score", "cut", "lang", "phrase", "a", "l", "r", "n")).alias("x")).select("x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return worst.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= first).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
