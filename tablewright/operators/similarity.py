"""Spelling variants and near-duplicate rows by edit distance, without comparing all pairs.

Two texts within d edits share, unchanged and nearly in place, at least one of d+1 pieces of
the shorter one (Li et al., "Pass-Join", VLDB 2011). Pieces become join keys, so only texts
with a common piece meet, and only those pairs are measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, vocab
from ..functions.accents import normalise_text
from ..functions.edits import long_edit_distance
from ..session import written
from .profile import value_counts
from .ranking import SINGLE_TASK_ROWS, global_index

# A piece shared by more texts than this is not joined on alone; see _meet.
FREQUENT_PIECE = 1000
MAX_DEPTH = 4
# Above this length the built-in distance, quadratic in it, gives way to a bounded one.
LONG_TEXT = 500
# Leaders are found in batches: items of the first one, candidate pairs of one.
FIRST_BATCH = 20_000
BATCH_PAIRS = 1_000_000
KEY = ["scope", "length", "edits", "piece", "hash"]


@dataclass(frozen=True)
class Closeness:
    """Edits allowed: an absolute limit and a share of the longer text's length."""

    short_length: int
    short_share: float
    long_share: float
    distance: int

    def allowed(self, length: Column) -> Column:
        share = F.when(length <= self.short_length, self.short_share).otherwise(self.long_share)
        return F.least(F.lit(self.distance), F.floor(share * length + 1e-9)).cast("int")


VALUES = Closeness(*vocab.FUZZY_VALUES)
ROWS = Closeness(*vocab.FUZZY_ROWS)


def _cut(length: Column, edits: Column, piece: Column) -> tuple[Column, Column]:
    """(start, size) of a 1-based piece when a text is cut into edits+1 nearly equal ones."""
    size = F.floor(length / (edits + 1))
    longer_from = edits + 1 - length % (edits + 1)
    start = (piece - 1) * size + F.greatest(piece - 1 - longer_from, F.lit(0))
    return start.cast("int"), (size + (piece > longer_from).cast("int")).cast("int")


def _piece(text: str, start: str, size: str) -> Column:
    return F.substring(F.col(text), F.col(start) + 1, F.col(size))


def _rest(text: str, start: str, size: str) -> Column:
    return F.concat(F.substring(F.col(text), F.lit(1), F.col(start)),
                    F.substring(F.col(text), F.col(start) + F.col(size) + 1, F.length(text)))


def _indexed(items: DataFrame) -> DataFrame:
    """Pieces of the shorter side. Items: scope, id, text, edits."""
    length, edits, piece = F.length("text"), F.col("edits"), F.col("piece")
    cut = items.withColumn("length", length).withColumn(
        "piece", F.explode(F.sequence(F.lit(1), edits + 1)))
    start, size = _cut(F.col("length"), edits, piece)
    return (cut.withColumn("start", start).withColumn("size", size)
            .withColumn("hash", F.xxhash64(_piece("text", "start", "size"))))


def _probing(items: DataFrame) -> DataFrame:
    """Substrings of the longer side that could equal a piece of a text of ``length``.

    With the first i-1 pieces changed by exactly i-1 edits, piece i lies at most i-1 places off,
    counted from the left, and at most edits+1-i off counted from the right.
    """
    edits, piece = F.col("edits"), F.col("piece")
    own = F.length("text")
    cut = items.withColumn("piece", F.explode(F.sequence(F.lit(1), edits + 1)))
    start, size = _cut(F.col("length"), edits, piece)
    cut = cut.withColumn("first", start).withColumn("size", size)
    gap = own - F.col("length")
    low = F.greatest(F.lit(0), F.col("first") - (piece - 1),
                     F.col("first") + gap - (edits + 1 - piece))
    high = F.least(own - F.col("size"), F.col("first") + (piece - 1),
                   F.col("first") + gap + (edits + 1 - piece))
    placed = (cut.withColumn("low", low).withColumn("high", high).where("low <= high")
              .withColumn("start", F.explode(F.sequence("low", "high"))))
    return placed.withColumn("hash", F.xxhash64(_piece("text", "start", "size")))


def _meet(short: DataFrame, long: DataFrame, frequent: int, n_items: int, depth: int) -> DataFrame:
    """Pairs of ids sharing a piece.

    Texts that share a frequent piece must be close in what is left of them too, so those meet
    on a second piece, taken from the rest of the text inside the scope of the first. That
    keeps every close pair while a common word never pairs everything that holds it.
    """
    left, right = _indexed(short), _probing(long)
    pair = [F.col("s.id").alias("id_a"), F.col("l.id").alias("id_b")]

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return (a.select("id", *KEY).alias("s").join(b.select("id", *KEY).alias("l"), KEY)
                .where("s.id <> l.id").select(*pair))

    if n_items <= frequent or depth >= MAX_DEPTH:
        return joined(left, right)
    hot = written(left.groupBy(*KEY).agg(F.count("*").alias("_n"))
                  .where(F.col("_n") > frequent).drop("_n"))
    if hot.isEmpty():
        return joined(left, right)
    cold = joined(left.join(hot, KEY, "left_anti"), right)
    inner = F.xxhash64(*KEY).alias("scope")
    rest = _rest("text", "start", "size").alias("text")
    # a rest too short to cut again still meets directly, as one whole piece of its length
    again = F.col("length") - F.col("size") > F.col("edits")
    short_hot, long_hot = left.join(hot, KEY, "left_semi"), right.join(hot, KEY, "left_semi")
    ended = joined(short_hot.where(~again), long_hot.where(~again))
    deeper = _meet(
        short_hot.where(again).select(inner, "id", rest, "edits").distinct(),
        long_hot.where(again).select(inner, "id", rest, "edits",
                                     (F.col("length") - F.col("size")).alias("length")).distinct(),
        frequent, n_items, depth + 1)
    return cold.unionByName(ended).unionByName(deeper)


def _shorter_side(sized: DataFrame, rule: Closeness) -> DataFrame:
    """Items once per number of edits that some text of their length or longer allows."""
    length = F.length("text")
    reach = F.sequence(length, length + rule.distance)
    budgets = F.array_distinct(F.filter(
        F.transform(reach, lambda m: F.when(m - length <= rule.allowed(m), rule.allowed(m))),
        lambda d: d >= 1))
    return sized.select("scope", "id", "text", F.explode(budgets).alias("edits"))


def _longer_side(sized: DataFrame, rule: Closeness) -> DataFrame:
    """Items once per length of a text they may be close to."""
    length = F.length("text")
    return (sized.withColumn("edits", rule.allowed(length)).where("edits >= 1")
            .select("scope", "id", "text", "edits",
                    F.explode(F.sequence(length - F.col("edits"), length)).alias("length")))


def _sized(items: DataFrame) -> DataFrame:
    """Items with a text; those of different scopes (a column, if there is one) never meet."""
    scope = F.col("scope") if "scope" in items.columns else F.lit(0)
    return items.select(scope.cast("long").alias("scope"), "id", "text").where(F.length("text") > 0)


def _measured(candidates: DataFrame, a: DataFrame, b: DataFrame, rule: Closeness, longest: int) -> DataFrame:
    """(id_a, id_b) with their distance, where the rule allows it; each pair is measured by its own length."""
    a = a.select(F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    b = b.select(F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    longer = F.greatest(F.length("text_a"), F.length("text_b"))
    edits = F.levenshtein("text_a", "text_b", rule.distance)
    if longest > LONG_TEXT:  # shorter pairs reach the bounded distance as nulls
        long = (lambda c: F.when(longer > LONG_TEXT, F.col(c)))
        edits = F.when(longer <= LONG_TEXT, edits).otherwise(
            long_edit_distance(long("text_a"), long("text_b"), rule.distance))
    measured = candidates.join(a, "id_a").join(b, "id_b").withColumn("distance", edits)
    return (measured.where((F.col("distance") >= 1) & (F.col("distance") <= rule.allowed(longer)))
            .select("id_a", "id_b", "distance"))


def close_pairs(items: DataFrame, rule: Closeness, frequent: int = FREQUENT_PIECE) -> DataFrame:
    """All pairs of items (id, text; texts distinct) within the rule, with their distance."""
    sized = written(_sized(items))
    n_items, longest = sized.agg(F.count("*"), F.max(F.length("text"))).first()
    met = _meet(_shorter_side(sized, rule), _longer_side(sized, rule), frequent, n_items, 1)
    candidates = met.select(F.least("id_a", "id_b").alias("id_a"),
                            F.greatest("id_a", "id_b").alias("id_b")).distinct()
    return _measured(candidates, sized, sized, rule, longest or 0)


def _close_to(found: DataFrame, batch: DataFrame, rule: Closeness, frequent: int,
              n_found: int, longest: int) -> DataFrame:
    """(id_a, id_b): leaders and the items of a batch that are close to them.

    Few leaders need no refined pieces: an item meets each of them at most.
    """
    shorter = _meet(_shorter_side(found, rule), _longer_side(batch, rule), frequent, n_found, 1)
    longer = _meet(_shorter_side(batch, rule), _longer_side(found, rule), frequent, n_found, 1)
    both = shorter.unionByName(longer.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    return _measured(both.distinct(), found, batch, rule, longest)


def grouped(items: DataFrame, rule: Closeness, order: list[str], frequent: int = FREQUENT_PIECE,
            first: int = FIRST_BATCH, pairs: int = BATCH_PAIRS) -> DataFrame:
    """Group items (id, text, order columns, perhaps scope) around leaders: (id, leader) for every item.

    Taken in order, an item joins the earliest leader it is close to and otherwise leads itself.

    Items are taken in batches of rank. A batch first meets the leaders so far; what is close to one
    follows it, for leaders of its own batch come later. Only what is left is compared among
    itself, and the pairs in a small part of it tell how much of it to take
    now; the rest goes to the next batch, where the new leaders claim most of a dense group. So a
    group of n alike texts makes about n pairs, not n * n.
    """
    named = global_index(_sized_with(items, order), [F.col(c) for c in order])
    ranked = written(named.select("id", "text", "scope", F.col("_index").cast("long").alias("place")))
    total, longest = ranked.agg(F.count("*"), F.max(F.length("text"))).first()
    longest, size, begin = longest or 0, first, 0
    found, done, waiting = None, [], None
    while begin < total or waiting is not None:
        new = ranked.where((F.col("place") >= begin) & (F.col("place") < begin + size)) if begin < total else None
        batch = new if waiting is None else waiting if new is None else waiting.unionByName(new)
        begin += size
        if found is not None:
            hits = _close_to(found, batch, rule, frequent, found.count(), longest).join(
                found.select(F.col("id").alias("id_a"), F.col("place").alias("leader_place")), "id_a")
            claimed = written(hits.groupBy(F.col("id_b").alias("id")).agg(
                F.min_by("id_a", "leader_place").alias("leader")))
            done.append(claimed)
            batch = written(batch.join(claimed, "id", "left_anti"))
        left = batch.count() if found is not None else min(size, total)
        taken = _affordable(batch, left, rule, frequent, pairs)
        waiting = None
        if taken < left:
            bound = batch.select("place").orderBy("place").limit(taken + 1).agg(F.max("place")).first()[0]
            waiting = batch.where(F.col("place") >= bound)
            batch = batch.where(F.col("place") < bound)
            size = max(first, taken)
        else:
            size *= 4
        own = written(leaders(batch, close_pairs(batch, rule, frequent), ["place"]))
        done.append(own)
        fresh = batch.join(own.where("id = leader").select("id"), "id", "left_semi")
        found = written(fresh if found is None else found.unionByName(fresh))
    return reduce(DataFrame.unionByName, done) if done else items.select("id", F.col("id").alias("leader"))


def _sized_with(items: DataFrame, order: list[str]) -> DataFrame:
    scope = F.col("scope") if "scope" in items.columns else F.lit(0)
    return items.select("id", "text", scope.cast("long").alias("scope"), *[c for c in order if c not in ("id", "text")])


def _affordable(batch: DataFrame, left: int, rule: Closeness, frequent: int, pairs: int) -> int:
    """How many of a batch, in order, have at most so many candidate pairs; steers sizes, never results."""
    if left * left <= 2 * pairs:
        return left
    share = -(-left // frequent)  # so few that pieces need no refining
    some = written(_sized(batch.where(F.pmod(F.xxhash64("place"), F.lit(share)) == 0)))
    n = some.count()
    met = _meet(_shorter_side(some, rule), _longer_side(some, rule), frequent, n, 1).count()
    expected = met * (left / max(1, n)) ** 2
    if expected <= pairs:
        return left
    few = int(left * (pairs / expected) ** 0.5)
    return few if few > 4 * frequent else min(left, frequent)


def leaders(items: DataFrame, pairs: DataFrame, order: list[str],
            single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Group items (id, order columns) around leaders: (id, leader) for every item.

    Taken in order, an item joins the earliest leader it is close to and otherwise leads
    itself.
    """
    ranked = items.select("id", F.struct(*order).alias("place"))
    a = ranked.select(F.col("id").alias("id_a"), F.col("place").alias("place_a"))
    b = ranked.select(F.col("id").alias("id_b"), F.col("place").alias("place_b"))
    both = pairs.join(a, "id_a").join(b, "id_b")
    forward = F.struct(F.col("id_a").alias("earlier"), F.col("place_a").alias("place"),
                       F.col("id_b").alias("later"), F.col("place_b").alias("later_place"))
    backward = F.struct(F.col("id_b").alias("earlier"), F.col("place_b").alias("place"),
                        F.col("id_a").alias("later"), F.col("place_a").alias("later_place"))
    edges = written(both.select(F.inline(F.array(
        F.when(F.col("place_a") < F.col("place_b"), forward).otherwise(backward)))))
    if edges.count() <= single_task_rows:
        ids = edges.select("later", F.col("earlier").alias("leader")).schema
        followers = edges.coalesce(1).mapInPandas(_follow_in_order, ids)
    else:
        followers = _follow_in_rounds(edges)
    return (items.select("id").join(followers.withColumnRenamed("later", "id"), "id", "left")
            .select("id", F.coalesce("leader", "id").alias("leader")))


def _follow_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pass itself over few edges: later items against the leaders before them."""
    parts = [b.assign(place=b["place"].map(lambda p: tuple(p.values())),
                      later_place=b["later_place"].map(lambda p: tuple(p.values())))
             for b in batches if len(b)]
    if not parts:
        return
    edges = pd.concat(parts)
    leader_of: dict = {}
    for row in edges.sort_values(["later_place", "place"]).itertuples():
        if row.later not in leader_of and row.earlier not in leader_of:
            leader_of[row.later] = row.earlier
    yield pd.DataFrame({"later": list(leader_of.keys()), "leader": list(leader_of.values())})


def _follow_in_rounds(edges: DataFrame) -> DataFrame:
    """The same result for any number of edges, decided in rounds.

    An item leads once every earlier neighbour is known to follow, and follows as soon as one
    earlier neighbour leads. Each round is written, so the next one starts from files.
    """
    status = written(edges.select(F.col("earlier").alias("id")).distinct().join(
        edges.select(F.col("later").alias("id")), "id", "left_anti")
        .withColumn("leads", F.lit(True)))
    while True:
        undecided = edges.select("earlier", "later").join(
            status.select(F.col("id").alias("later")), "later", "left_anti")
        known = undecided.join(status.withColumnRenamed("id", "earlier"), "earlier", "left")
        judged = known.groupBy("later").agg(
            F.bool_or(F.coalesce("leads", F.lit(False))).alias("near_leader"),
            F.bool_and(F.coalesce(~F.col("leads"), F.lit(False))).alias("all_follow"))
        decided = written(judged.where("near_leader OR all_follow").select(
            F.col("later").alias("id"), (~F.col("near_leader")).alias("leads")))
        if decided.isEmpty():
            break
        status = status.unionByName(decided)
    leading = status.where("leads").select(F.col("id").alias("earlier"))
    following = status.where(~F.col("leads")).select(F.col("id").alias("later"))
    return (edges.join(leading, "earlier", "left_semi").join(following, "later", "left_semi")
            .groupBy("later").agg(F.min_by("earlier", "place").alias("leader")))


def spelling_map(df: DataFrame, column: str, rule: Closeness = VALUES,
                 frequent: int = FREQUENT_PIECE) -> DataFrame:
    """(value, canonical) for every distinct value: variants go to the most frequent spelling."""
    return spelling_map_of_counts(value_counts(df, [column]).select("value", "count"), rule,
                                  frequent)


def spelling_map_of_counts(values: DataFrame, rule: Closeness = VALUES,
                           frequent: int = FREQUENT_PIECE) -> DataFrame:
    """The same from (value, count); equal counts are settled by value."""
    counts = written(  # one row per distinct value, read several times below
        values.select("value", "count", normalise_text(F.col("value")).alias("norm"))
        .where("norm <> ''"))
    forms = counts.groupBy("norm").agg(
        F.min(F.struct((-F.col("count")).alias("rank"), "value")).alias("best"))
    # texts whose digits differ name different things, however alike they look, and never meet
    digits = F.xxhash64(F.regexp_replace("norm", "[^0-9]", ""))
    items = forms.select(F.col("norm").alias("id"), F.col("norm").alias("text"), digits.alias("scope"),
                         F.col("best.rank").alias("rank"), F.col("best.value").alias("value"))
    led = grouped(items, rule, ["rank", "value"], frequent)
    canonical = led.join(items.select(F.col("id").alias("leader"),
                                      F.col("value").alias("canonical")), "leader")
    return counts.join(canonical.withColumnRenamed("id", "norm"), "norm").select(
        "value", "canonical")


def apply_map(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace values of a column through a (value, canonical) table.

    Only entries that change something are joined; Spark broadcasts them when they are small.
    """
    changed = mapping.where(F.col("value") != F.col("canonical")).select(
        F.col("value").alias(column), "canonical")
    return (df.join(changed, column, "left")
            .withColumn(column, F.coalesce("canonical", column)).select(*df.columns))


def row_signatures(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """One row per distinct content of the text columns: (id = smallest row id, text)."""
    columns = columns or signature_columns(df, row_id)
    return (_signed(df, row_id, columns).groupBy("raw").agg(F.min(row_id).alias("id"))
            .select("id", normalise_text(F.col("raw")).alias("text")).where("text <> ''")
            .groupBy("text").agg(F.min("id").alias("id")).select("id", "text"))


def signature_columns(df: DataFrame, row_id: str) -> list[str]:
    return [c for c in names.text_columns(df, [row_id]) if not c.endswith("_month_name")]


def _signed(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    raw = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return df.select(row_id, raw.alias("raw"))


def near_duplicate_rows(df: DataFrame, row_id: str, rule: Closeness = ROWS,
                        frequent: int = FREQUENT_PIECE,
                        columns: list[str] | None = None) -> DataFrame:
    """Rows that resemble, but do not equal, the first row of their cluster.

    (row id, cluster id) for every row of every cluster holding at least two different
    contents. Nothing is removed: this is a report.
    """
    columns = columns or signature_columns(df, row_id)
    items = written(row_signatures(df, row_id, columns))
    led = grouped(items, rule, ["id"], frequent)
    shared = led.where("id <> leader").select("leader").distinct()
    clustered = led.join(shared, "leader", "left_semi").join(items, "id")
    # texts can be long; rows are matched to them by digest
    digest = F.sha2(normalise_text(F.col("raw")), 256)
    rows = _signed(df, row_id, columns).select(row_id, digest.alias("digest"))
    return rows.join(clustered.select(F.sha2("text", 256).alias("digest"),
                                      F.col("leader").alias("cluster_id")), "digest").select(
        F.col(row_id).alias("row_id"), "cluster_id")
