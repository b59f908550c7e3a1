"""Main text of web pages; what pages of a host repeat is boilerplate.

The structure of a page tells its blocks apart: text in menus, headers, footers, sidebars, notices,
adverts, forms and comments is dropped, text in an article or main element is kept unless its host
repeats it on most pages, and other blocks of a page without a main element are open. What a host
repeats is found in the streams of tokens of all its pages as a suffix array: suffixes are brought
together by their first `min_tokens` tokens, and neighbours from different pages share at least so
many. Such a shared run is boilerplate

* in open blocks if it is outside main elements on two pages of the host (token by token),
* in main elements if it is anywhere on at least `min_pages` and three quarters of the pages of the host. As
  articles quote lines and licenses, only whole blocks made of such runs go, and a page
  that would lose over half of its main element keeps it all: it is one of many alike.

The array for open blocks is partitioned by host and first tokens, and a shared beginning needs only
the smallest and the largest page that has it, so neither a large host nor a frequent line meets in
one task. For main elements each task sorts the suffixes of chunks of pages. A run on three quarters of a host's pages is
on three quarters of those in some chunk, so only such runs are candidates; a second pass counts them in all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import page_structure as structure
from .scratch import Tables
from .tokens import PLAIN, U, grams, join_hash, words_of

MIN_TOKENS = 6
MIN_PAGES = 10  # of a host: with fewer, most pages may be articles that quote each other
CHUNK_RUNS = 1 << 21  # at least, of a task with so many; up to twice as many are sorted at once
FILTER_SLOTS = 1 << 22  # lets some runs through too many and none too few
OUTPUT = ("text", "n_chars")
_PARTS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("text", T.StringType())]))


def page_blocks(html: str) -> Column:
    """Blocks of each page in order: kind (0 boilerplate, 1 main element, 2 open) and text."""

    @F.arrow_udf(_PARTS)
    def parse(pages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))
        return pa.array([[{"kind": k, "text": t} for k, t in structure.blocks(p or "")] for p in pages.to_pylist()], kind)

    return parse(F.col(html))


def host_of(url: Column) -> Column:
    """Host of an address in lower case; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host)


def _main(parts: Column, kind: int) -> Column:
    return F.concat_ws(" ", F.transform(F.filter(parts, lambda b: b["kind"] == kind), lambda b: b["text"]))


def _streams(pages: DataFrame, min_tokens: int) -> DataFrame:
    """Suffixes of the token streams outside main elements: host, head (hash of the first tokens), page, place, uid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([" ".join(b["text"] for b in row if b["kind"] != structure.CONTENT) for row in batch.column(3).to_pylist()], pa.string())
            for part in words_of(texts, PLAIN, lower=False):
                bounds = part.bounds
                for i in range(len(part.counts)):
                    head = grams(part.hashes[bounds[i]: bounds[i + 1]], min_tokens)
                    if len(head):
                        own = pa.array(np.zeros(len(head), np.int64))
                        yield pa.RecordBatch.from_arrays([
                            *[batch.column(c).slice(part.first + i, 1).take(own) for c in range(3)],
                            pa.array(head.view(np.int64)), pa.array(np.arange(len(head), dtype=np.int32))],
                            ["host", "page", "uid", "head", "place"])

    return pages.select("host", "page", "uid", "parts").mapInArrow(run, "host string, page bigint, uid bigint, head bigint, place int")


def _without_repeats(min_tokens: int):
    """Open blocks of a page without the tokens inside repeated runs."""

    @F.arrow_udf(T.StringType())
    def keep(parts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for row, starts in zip(parts.to_pylist(), places.to_pylist()):
            tokens = [(b["kind"], t) for b in row for t in b["text"].split() if b["kind"] != structure.CONTENT]
            covered = np.zeros(len(tokens) + min_tokens + 1, np.int32)
            for place in starts or ():
                covered[place] += 1
                covered[place + min_tokens] -= 1
            covered = np.cumsum(covered)
            out.append(" ".join(t for i, (kind, t) in enumerate(tokens) if kind == structure.OPEN and not covered[i]))
        return pa.array(out, pa.string())

    return keep


def _most(pages, of):
    """Whether so many pages are three quarters of all; lines that articles quote are on up to 0.41 of a host's pages of the check tool's skewed table."""
    return 4 * pages >= 3 * of


def _runs(batch: pa.RecordBatch, min_tokens: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and different runs (hash of host and first tokens) of each page; columns are site, n and text."""
    sites = batch.column(0).to_numpy().view(U)
    for part in words_of(batch.column(2), PLAIN, lower=False):
        bounds = part.bounds
        for i in range(len(part.counts)):
            yield part.first + i, np.unique(join_hash(grams(part.hashes[bounds[i]: bounds[i + 1]], min_tokens), sites[part.first + i]))


def _counted(pages: DataFrame, min_tokens: int, chunk_runs: int, wanted: np.ndarray | None = None) -> DataFrame:
    """Pages per run in chunks of pages: key, site, n (pages of the host), pages.

    Only the runs on most of the host's pages of the chunk, or those that the filter `wanted` lets through.
    """

    def count(chunk: list[tuple[np.ndarray, int, int]]) -> Iterator[pa.RecordBatch]:
        site, owner = np.unique(np.array([c[1] for c in chunk], np.int64), return_inverse=True)
        total = np.zeros(len(site), np.int64)
        total[owner] = [c[2] for c in chunk]
        keys, first, pages = np.unique(np.concatenate([c[0] for c in chunk]), return_index=True, return_counts=True)
        owners = np.repeat(owner, [len(c[0]) for c in chunk])[first]
        kept = np.flatnonzero(_most(pages, np.bincount(owner)[owners])) if wanted is None else np.arange(len(keys))
        for at in range(0, len(kept), 1 << 16):
            own = kept[at: at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), pa.array(site[owners[own]]), pa.array(total[owners[own]]),
                                              pa.array(pages[own])], ["key", "site", "n", "pages"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, chunk, size = [], [], 0
        for batch in batches:
            site, total = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, keys in _runs(batch, min_tokens):
                if wanted is not None:
                    keys = keys[wanted[(keys & U(len(wanted) - 1)).view(np.int64)]]
                chunk.append((keys, site[row], total[row]))
                size += len(keys) + 1
                if size >= chunk_runs:
                    if full:
                        yield from count(full)
                    full, chunk, size = chunk, [], 0
        if full or chunk:  # the rest of a task is no chunk of its own: of few pages each is half
            yield from count(full + chunk)

    return pages.mapInArrow(run, "key bigint, site bigint, n bigint, pages bigint")


def _frequent(tables: Tables, parsed: DataFrame, min_tokens: int, min_pages: int, chunk_runs: int) -> DataFrame:
    """Runs on at least `min_pages` and three quarters of the different pages of a host: site (hash of the host) and its keys.

    A host has at most 4/3 as many as its pages have different runs on average. Where over a twentieth of the pages have no
    other of their host near them, the pages are brought together by host before they are cut into chunks.
    """
    firsts = tables.write(parsed.groupBy("host", "page").agg(F.min("uid").alias("uid")))
    hosts = tables.write(firsts.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages))
    copies = tables.write(parsed.select("uid").join(firsts.select("uid"), "uid", "left_anti"))
    single = parsed.join(hosts, "host").join(copies, "uid", "left_anti")
    near = (firsts.join(hosts, "host").groupBy("host", F.shiftright("uid", 11)).agg(F.count("*").alias("near"))
            .agg(F.sum(F.when(F.col("near") == 1, F.col("near"))), F.sum("near")).first())
    scattered = 20 * (near[0] or 0) > (near[1] or 0)
    columns = [F.xxhash64("host").alias("site"), "n", F.concat_ws(" ", F.col("parts.text")).alias("text")]
    together = single.select(*columns, "uid").repartitionByRange("site", "uid").drop("uid") if scattered else single.select(*columns)
    candidates = tables.write(_counted(together, min_tokens, chunk_runs).select("key", "site", "n").distinct())
    wanted = np.zeros(FILTER_SLOTS, bool)
    wanted[candidates.select(F.col("key").bitwiseAND(FILTER_SLOTS - 1).alias("slot")).distinct().toArrow().column(0).to_numpy()] = True
    often = candidates
    if wanted.any():
        counts = _counted(single.select(*columns), min_tokens, chunk_runs, wanted)
        often = (counts.select("key", "pages").join(candidates, "key").groupBy("key", "site", "n").agg(F.sum("pages").alias("pages"))
                 .filter((F.col("pages") >= min_pages) & _most(F.col("pages"), F.col("n"))))
    return tables.write(often.groupBy("site").agg(F.collect_list("key").alias("keys")))


def _without_frequent(min_tokens: int):
    """Main element of a page without the blocks made of frequent runs; whole if these are over half of it."""

    @F.arrow_udf(T.StringType())
    def keep(parts: pa.Array, sites: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        rows, own = parts.to_pylist(), sites.to_numpy().view(U)
        for part in words_of(pa.array([" ".join(b["text"] for b in row) for row in rows], pa.string()), PLAIN, lower=False):
            bounds = part.bounds
            for i in range(len(part.counts)):
                row = part.first + i
                runs = join_hash(grams(part.hashes[bounds[i]: bounds[i + 1]], min_tokens), own[row])
                places = np.flatnonzero(np.isin(runs, keys[row].values.to_numpy().view(U)))
                edges = np.zeros(int(part.counts[i]) + 1, np.int64)
                np.add.at(edges, places, 1)
                np.add.at(edges, places + min_tokens, -1)
                covered = np.cumsum(edges) > 0
                kept, at, size, lost = [], 0, 0, 0
                for block in rows[row]:
                    length = block["text"].count(" ") + 1
                    if block["kind"] == structure.CONTENT:
                        gone = bool(covered[at: at + length].all())
                        kept.append((gone, block["text"]))
                        size += length
                        lost += length * gone
                    at += length
                out.append(" ".join(text for gone, text in kept if 2 * lost > size or not gone))
        return pa.array(out, pa.string())

    return keep


def main_text(pages: DataFrame, *, html: str = "html", url: str = "url", columns: Sequence[str] | None = None,
              min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, chunk_runs: int = CHUNK_RUNS) -> DataFrame:
    """The given columns (all but the html by default) plus text and n_chars (code points).

    Null, empty and textless pages have the text ''. Repeated pages (equal html) are one page for
    the search of repeats, and each row gets its text. Pages without a host are one host. A main
    element is only shortened by whole blocks that a host repeats on `min_pages` and three quarters of its pages, never
    by more than half of it. Columns named like an output are replaced. No rows in, no rows out.
    """
    tables = Tables(pages.sparkSession, "boilerplate")
    kept = [c for c in (pages.columns if columns is None else columns) if c.lower() not in OUTPUT and (columns is not None or c != html)]
    parsed = tables.write(pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"),
        F.xxhash64(html).alias("page"), page_blocks(html).alias("parts")).withColumn("uid", F.monotonically_increasing_id()))
    is_open = ~F.exists("parts", lambda b: b["kind"] == structure.CONTENT) & F.exists("parts", lambda b: b["kind"] == structure.OPEN)
    decided = parsed.filter(~is_open).withColumn("site", F.xxhash64("host"))
    frequent = _frequent(tables, parsed, min_tokens, min_pages, chunk_runs)
    whole = _main(F.col("parts"), structure.CONTENT).alias("text")
    if frequent.limit(1).count():
        shortened = _without_frequent(min_tokens)(F.col("parts"), F.col("site"), F.col("keys")).alias("text")
        done = decided.join(frequent, "site", "left_anti").select("row", whole).unionByName(decided.join(frequent, "site").select("row", shortened))
    else:
        done = decided.select("row", whole)
    undecided = parsed.filter(is_open)
    if undecided.limit(1).count():
        suffixes = tables.write(_streams(parsed.join(undecided.select("host").distinct(), "host", "left_semi"), min_tokens))
        repeated = suffixes.groupBy("host", "head").agg(F.min("page").alias("a"), F.max("page").alias("b")).filter("a <> b").select("host", "head")
        places = (suffixes.join(undecided.select("uid"), "uid", "left_semi").join(repeated, ["host", "head"], "left_semi")
                  .groupBy("uid").agg(F.collect_list("place").alias("places")))  # one page's places
        done = done.unionByName(undecided.join(places, "uid", "left").select(
            "row", _without_repeats(min_tokens)(F.col("parts"), F.col("places")).alias("text")))
    return done.select("row.*", "text", F.length("text").cast("bigint").alias("n_chars"))
