"""Near-duplicate classes by an exact n-gram Jaccard join over a token-group matrix.

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of at
least 0.8 (both parameters). The join is exact up to 64-bit hashes, with no cap on partners:

1. Equal sets are one set. Its shingles are put in one order everywhere: by the power of two
   of the number of documents that hold them, then by hash. Linked sets must share a shingle
   among the first ``n - ceil(t * n) + 1`` in this order (their prefix), and a shingle that no
   other set holds cannot be it. Sets whose prefix is all their own are done.
2. The remaining sets are partitioned into groups of similar sets by the shared shingle of the
   smallest hash, which variants of one text mostly have in common; a large group is cut into parts of bounded size. Inside a part all sets are compared. The few sets
   with most links in any part of a group then visit all its parts, which connects
   the copies of one text.
3. The matrix holds for each part the shingles of its sets' prefixes; shingles held by the same
   parts are one column. A set looks up its own columns and visits the parts that hold one of
   them in a set of a larger component (equal sizes: of a larger root). At a part, its overlap with
   the union of all shingles there bounds what it can share with any member, and the part is
   opened only if the bound reaches ``t * n``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import pack, text_blocks, unpack, unpack_numbers
from .components import components
from .scratch import SMALL_GROUPS, Tables
from .tokens import U, grams, mix

WORDS, PERCENT = 5, 80
#: Texts and blocks that are between a task and its Python worker, or read from files, at once.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "1048576",
                 "spark.sql.parquet.columnarReaderBatchSize": "64"}
BLOCK_WORDS = 62_500       # words of the documents whose shingles are sent together; a block is a row of under a MB, or one text
SLICE_BYTES = 128 << 10    # of text added to a block at once
BUCKET_WORDS = 2_000_000   # shingles counted in one task
GROUP_SETS, GROUP_SHINGLES = 128, 2_000_000
HUBS = 8                   # sets that visit all parts of their group
VISITS = 512               # visits to a part handled in one task
OUTPUT = ("n_shingles", "component_id")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in SMALL_BATCHES}
    for key, value in SMALL_BATCHES.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _shingle_sets(hashes: np.ndarray, counts: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text."""
    whole = grams(hashes, words)
    at = 0
    for n in counts.tolist():
        yield _distinct(whole[at: at + n - words + 1] if n >= words else grams(hashes[at: at + n], n) if n else np.zeros(0, U))
        at += n


def _set_id(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        value = mix(np.array([mix(shingles).sum(dtype=U) * U(31) + U(len(shingles))], U))
    return int(value.view(np.int64)[0])


def _decode(row: dict, words: int) -> Iterator[np.ndarray]:
    counts = np.frombuffer(row["counts"], np.int64)
    return _shingle_sets(np.frombuffer(row["vocab"], U)[unpack_numbers(row["ids"], row["words"])], counts, words)


def _set_rows(blocks: DataFrame, words: int) -> DataFrame:
    """Each row of the blocks with n (distinct shingles) and id (of the set; null if it is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sets = list(_decode({c: batch.column(c)[i].as_py() for c in ("counts", "words", "vocab", "ids")}, words))
                yield pa.RecordBatch.from_arrays([
                    batch.column("rows")[i].values, pa.array([len(own) for own in sets], pa.int64()),
                    pa.array([_set_id(own) if len(own) else None for own in sets], pa.int64())], ["row", "n", "id"])

    row = blocks.schema["rows"].dataType.elementType
    return blocks.select("rows", "counts", "words", "vocab", "ids").mapInArrow(run, T.StructType([
        T.StructField("row", row), T.StructField("n", T.LongType()), T.StructField("id", T.LongType())]))


def _block_sets(row: dict, words: int) -> list[np.ndarray]:
    """Distinct sets of a block with at least one shingle."""
    found: dict[bytes, np.ndarray] = {}
    for own in _decode(row, words):
        if len(own):
            found.setdefault(own.tobytes(), own)
    return list(found.values())


def _requests(blocks: DataFrame, bits: int, words: int) -> DataFrame:
    """Per block and bucket: 32 more bits of each distinct shingle in order, and counts over 1."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("shingles", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sets = _block_sets(row, words)
                if not sets:
                    continue
                every = np.sort(np.concatenate(sets))
                first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
                values, counts = every[first], np.diff(np.append(first, len(every)))
                edges = np.searchsorted(values >> U(64 - bits) if bits else np.zeros(len(values), U), np.arange((1 << bits) + 1, dtype=U))
                edges[-1] = len(values)
                low = ((values >> U(32 - bits)) & U(0xFFFFFFFF)).astype(np.uint32)
                out = []
                for bucket in range(1 << bits):
                    a, b = int(edges[bucket]), int(edges[bucket + 1])
                    if b > a:
                        many = np.flatnonzero(counts[a:b] > 1)
                        out.append({"bucket": bucket, "block": row["block"], "shingles": low[a:b].tobytes(),
                                    "many": many.astype(np.uint32).tobytes(), "counts": counts[a:b][many].astype(np.uint32).tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return blocks.select("block", "counts", "words", "vocab", "ids").mapInArrow(run, "bucket int, block string, shingles binary, many binary, counts binary")


def _levels(requests: DataFrame) -> DataFrame:
    """Per block and bucket: the power of two of each shingle's documents, in the order asked."""

    def run(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(x, np.uint32) for x in table["shingles"].to_pylist()]
        numbers = []
        for own, many, counts in zip(asked, table["many"].to_pylist(), table["counts"].to_pylist()):
            n = np.ones(len(own), np.int64)
            n[np.frombuffer(many, np.uint32)] = np.frombuffer(counts, np.uint32)
            numbers.append(n)
        values, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(place, np.concatenate(numbers), len(values))
        level = np.log2(total).astype(np.uint8)[place]
        ends = np.cumsum([len(x) for x in asked])
        return pa.table({"block": table["block"], "bucket": table["bucket"],
                         "levels": pa.array([pack(level[e - len(x): e]) for x, e in zip(asked, ends)], pa.binary()),
                         "n": pa.array([len(x) for x in asked], pa.int64())})

    return requests.groupBy("bucket").applyInArrow(run, "block string, bucket int, levels binary, n bigint")


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """So many first shingles hold one of any linked set."""
    return n - (percent * n + 99) // 100 + 1


def index_length(n: int, percent: int = PERCENT) -> int:
    """So many first shingles hold one of any linked set that is not smaller."""
    return n - (2 * percent * n + 99 + percent) // (100 + percent) + 1


def _live_sets(blocks: DataFrame, levels: DataFrame, words: int, percent: int) -> DataFrame:
    """Sets that may link: id, n, alone (shingles of no other set), key, prefix (shared shingles in it), indexed
    (how many of them meet larger sets), shingles (all shared ones)."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("key", pa.int64()), ("prefix", pa.list_(pa.int64())),
                        ("indexed", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sets = _block_sets(row, words)
                _, place = np.unique(np.concatenate(sets), return_inverse=True)
                level = np.concatenate([unpack(x["levels"], np.uint8, x["n"]) for x in sorted(row["levels"], key=lambda x: x["bucket"])])[place]
                out, at = [], 0
                for own in sets:
                    lv = level[at: at + len(own)]
                    at += len(own)
                    alone = int((lv == 0).sum())
                    length = prefix_length(len(own), percent)
                    if alone < length:
                        shared, lv = own[lv > 0], lv[lv > 0]
                        prefix = shared[np.argsort(lv, kind="stable")[: length - alone]].view(np.int64)
                        out.append({"id": _set_id(own), "n": len(own), "alone": alone, "key": int(shared.view(np.int64)[0]), "prefix": prefix,
                                    "indexed": max(0, index_length(len(own), percent) - alone), "shingles": shared.tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    answers = levels.groupBy("block").agg(F.collect_list(F.struct("bucket", "levels", "n")).alias("levels"))
    return blocks.select("block", "counts", "words", "vocab", "ids").join(answers, "block").mapInArrow(run, 
        "id bigint, n bigint, alone bigint, key bigint, prefix array<bigint>, indexed bigint, shingles binary")


class Group:
    """The sets of one group: the union of their shingles, and who holds each."""

    def __init__(self, sets: Sequence[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        every = np.concatenate(sets) if len(sets) else np.zeros(0, U)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.union, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))

    def linked(self, shingles: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Members that link with a set; none without opening the group if the bound fails."""
        at = np.searchsorted(self.union, shingles)
        inside = at < len(self.union)
        at, shingles = at[inside], shingles[inside]
        at = at[self.union[at] == shingles]  # a shingle that is not held lands on the next larger one
        if 100 * len(at) < percent * n:
            return np.zeros(0, np.int64)
        many = self.first[at + 1] - self.first[at]
        places = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        both = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (n + self.sizes - both))


def _inside(table: pa.Table, percent: int) -> pa.Table:
    """Links of a part that connect its sets, and, if the group has more parts, the sets with most links."""
    ids, sizes = table["id"].to_pylist(), table["n"].to_numpy()
    stored = table["shingles"].to_pylist()
    sets = [np.frombuffer(x, U) for x in stored]
    group = Group(sets, sizes)
    parent, links = list(range(len(ids))), np.zeros(len(ids), np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        found = group.linked(own, int(sizes[i]), percent)
        links[i] = len(found)
        for j in found.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [{"a": ids[i], "b": ids[root(i)]} for i in range(len(ids)) if root(i) != i]
    if table["parts"][0].as_py() > 1:
        first = sorted(range(len(ids)), key=lambda i: (-links[i], ids[i]))[:HUBS]
        out += [{"a": ids[i], "n": int(sizes[i]), "key": table["key"][i].as_py(), "shingles": stored[i], "links": int(links[i])} for i in first]
    return pa.Table.from_pylist(out, schema=_LINKS)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("shingles", pa.binary()), ("links", pa.int64())])


def _with_parts(sets: DataFrame) -> DataFrame:
    """Cut groups (equal key) into parts of bounded size; adds part and parts.

    Sets with few and with many shingles of their own are in different groups, for these cannot link
    with each other.
    """
    sets = sets.withColumn("key", F.xxhash64("key", F.floor(F.col("alone") * 20 / F.col("n"))))
    sizes = sets.groupBy("key").agg(F.count("*").alias("sets"), F.sum(F.length("shingles") / 8).alias("total")).filter(
        f"sets > {GROUP_SETS} or total > {GROUP_SHINGLES}").select(
        "key", F.ceil(F.greatest(F.col("sets") / GROUP_SETS, F.col("total") / GROUP_SHINGLES)).alias("parts"))
    return (sets.join(sizes, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))))


def _meet(percent: int):
    """Guests look for links among the other sets of a table; one link per root that they do not have."""

    def run(table: pa.Table) -> pa.Table:
        guest = table["guest"].to_numpy(zero_copy_only=False)
        sizes, root = table["n"].to_numpy(), table["root"].to_numpy()
        sets = [np.frombuffer(x, U) for x in table["shingles"].to_pylist()]
        members = np.flatnonzero(~guest)
        group = Group([sets[i] for i in members], sizes[members])
        a, b = [], []
        for i in np.flatnonzero(guest).tolist():
            found = {int(root[members[j]]) for j in group.linked(sets[i], int(sizes[i]), percent)} - {int(root[i])}
            a += [int(root[i])] * len(found)
            b += sorted(found)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _connect_inside(sets: DataFrame, tables: Tables, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sets with key, part and parts, and links (a, b) within groups."""
    grouped = tables.write(_with_parts(sets))
    inside = tables.write(grouped.select("id", "n", "key", "shingles", "part", "parts").groupBy("key", "part").applyInArrow(
        lambda table: _inside(table, percent), "a bigint, b bigint, n bigint, key bigint, shingles binary, links bigint"))
    links = inside.filter("b is not null").select("a", "b")
    best = Window.partitionBy("key").orderBy(F.desc("links"), "a")
    hubs = inside.filter("b is null").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= HUBS)
    large = grouped.filter("parts > 1")
    spread = large.select("key", "parts").distinct()
    guests = hubs.join(spread, "key").select(F.col("a").alias("id"), "n", F.col("a").alias("root"), "key", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "shingles", F.lit(True).alias("guest"))
    hosts = large.select("id", "n", F.col("id").alias("root"), "key", "part", "shingles", F.lit(False).alias("guest"))
    met = guests.unionByName(hosts).groupBy("key", "part").applyInArrow(_meet(percent), "a bigint, b bigint")
    return grouped, tables.write(links.unionByName(met))


def _visit(sets: DataFrame, links: DataFrame, tables: Tables, percent: int) -> DataFrame:
    """Links (a, b) between components of different parts that are not connected yet.

    Of two components the smaller one looks for the larger, so the copies of one text stay where they are and
    the few sets that are not connected with them travel.
    """
    roots = components(links, tables)
    members = roots.groupBy("root").agg(F.count("*").alias("members"))
    named = tables.write(sets.join(roots.join(members, "root").withColumnRenamed("node", "id"), "id", "left").select(
        "id", "n", "alone", F.struct(F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("root", "id").alias("root")).alias("class"),
        F.concat_ws("/", "key", "part").alias("group"), "prefix", "indexed", "shingles"))
    entries = named.select("id", "n", "alone", "class", "group", "indexed", F.posexplode("prefix").alias("place", "shingle")).withColumn(
        "early", F.col("place") < F.col("indexed"))  # enough for the smaller set of a pair
    # shingles of the same groups are one column of the matrix; what one group or one component holds is none
    columns = (entries.groupBy("shingle", "group").agg(F.min("class").alias("low"), F.max("class").alias("high"))
               .groupBy("shingle").agg(F.bit_xor(F.xxhash64("group")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "group")).alias("y"),
                                       F.count("*").alias("groups"), F.min("low").alias("low"), F.max("high").alias("high"))
               .filter("groups > 1 and low < high").select("shingle", F.concat_ws("/", "x", "y").alias("column")))
    seekers = tables.write(entries.join(columns, "shingle").groupBy("column", "id").agg(
        F.max("early").alias("early"), *[F.first(c).alias(c) for c in ("n", "alone", "class", "group")]))
    matrix = tables.write(seekers.groupBy("column", "group").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min(F.when(F.col("early"), F.col("n"))).alias("least_early"),
        F.min("alone").alias("least_alone"), F.max("class").alias("largest")))
    seekers = seekers.withColumnRenamed("group", "home")
    # a member that is not larger was met early by its own prefix, a larger one early by the seeker's
    smaller = (F.col("least_early") <= F.col("n")) & (F.col("most") * 100 >= F.col("n") * percent)
    larger = F.col("early") & (F.col("most") > F.col("n")) & (F.col("n") * 100 >= F.col("least") * percent)
    # what neither set shares with any other is in the union
    common = F.col("n") - F.col("alone")
    visits = tables.write(seekers.join(matrix, (seekers["column"] == matrix["column"]) & (F.col("home") != F.col("group"))
                                       & (F.col("class") < F.col("largest")) & (F.coalesce(smaller, F.lit(False)) | larger)
                                       & (common * 100 >= (F.col("n") + F.col("least_alone")) * percent)).select("id", "group").distinct())
    named = named.withColumn("root", F.col("class.root"))
    tasks = visits.groupBy("group").agg(F.ceil(F.count("*") / VISITS).alias("tasks"))
    guests = visits.join(tasks, "group").select("id", "group", F.pmod(F.xxhash64("id"), F.col("tasks")).alias("task")).join(
        named.select("id", "n", "root", "shingles"), "id").withColumn("guest", F.lit(True))
    hosts = named.join(tasks, "group").select(
        "id", "group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)).alias("task"), "n", "root", "shingles").withColumn(
        "guest", F.lit(False))
    order = ["id", "group", "task", "n", "root", "shingles", "guest"]
    met = guests.select(order).unionByName(hosts.select(order)).groupBy("group", "task").applyInArrow(_meet(percent), "a bigint, b bigint")
    return tables.write(met.distinct())


def similarity_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", columns: Sequence[str] | None = None,
                       words: int = WORDS, percent: int = PERCENT, block_words: int = BLOCK_WORDS,
                       bucket_words: int = BUCKET_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The given columns (all by default) plus n_shingles, component_id, set_id (null if empty).

    component_id is the smallest doc_id (of any type with an order) in the class of linked documents. Null and empty texts,
    and texts of white space only, have no shingles and are classes of their own; fewer than
    `words` words are one shingle. Repeated rows fall in one class. A null doc_id is kept and
    takes the smallest one of its class, if any. Columns named like an output are replaced. No
    rows in, no rows out.
    """
    tables = Tables(docs.sparkSession, "jaccard", SMALL_GROUPS)
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in (*OUTPUT, "set_id")]
    packed = docs.select(F.struct(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(doc_id).alias("doc")).alias("row"),
                         F.lit(False).alias("held"), F.col(text).alias("text"))
    with _small_batches(docs.sparkSession):
        blocks = tables.write(text_blocks(packed, block_words, slice_bytes=slice_bytes))
        rows = tables.write(_set_rows(blocks, words).select("row.row", "row.doc", "n", "id"))
        total = blocks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        bits = max(0, int(np.ceil(np.log2(max(1, total / bucket_words)))))
        levels = tables.write(_levels(_requests(blocks, bits, words)))
        live = tables.write(_live_sets(blocks, levels, words, percent).dropDuplicates(["id"]))
        tables.remove(blocks)
        tables.remove(levels)
        sets, links = _connect_inside(live, tables, percent)
        met = _visit(sets, links, tables, percent)
        roots = components(links.unionByName(met), tables)

        known = rows.filter("n > 0").groupBy("id").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"))
        named = tables.write(known.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
        smallest = named.groupBy("root").agg(F.min("doc").alias("component_id"))
        final = tables.write(named.join(smallest, "root").select("id", "component_id", "copies"))
    # sets with over a thousandth of the rows, fewer than 1000, are not joined by a shuffle
    n_rows = final.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = final.filter(F.col("copies") * 1000 > n_rows).drop("copies")
    by_hot = rows.join(F.broadcast(hot), "id", "left")
    done = by_hot.filter("component_id is not null or n = 0")
    rest = by_hot.filter("component_id is null and n > 0").drop("component_id").join(final.drop("copies"), "id", "left")
    return done.unionByName(rest).select(
        "row.*", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
        F.col("id").alias("set_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each class, columns unchanged: the smallest doc_id, of equal ones any single row.

    Texts without words are near nothing and all stay.
    """
    names = docs.columns
    tables = Tables(docs.sparkSession, "jaccard-kept")
    text = options.pop("text", "text")
    placed = _placed(docs, tables)  # blocks carry a row's place, never the row
    packed = placed.select("_place", F.col(f"_row.`{doc_id}`").alias("_doc"), F.col(f"_row.`{text}`").alias("_text"))
    found = tables.write(similarity_classes(packed, doc_id="_doc", text="_text", columns=["_place", "_doc"], **options))
    # of a class: the row whose doc_id is the smallest (null last), then the first place
    first = found.filter("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct(F.col("_doc").isNull().alias("x"), "_doc", "_place")).alias("best"),
                                                                 F.min("component_id").alias("component_id"))
    class_of = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("set"), F.col("set_id")))
    best = first.groupBy(class_of.alias("class")).agg(F.min("best").alias("best")).select(F.col("best._place").alias("_place"))
    kept = placed.join(best.unionByName(found.filter("n_shingles = 0").select("_place")), "_place", "left_semi")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])


def _placed(docs: DataFrame, tables: Tables) -> DataFrame:
    """_place, which names a row for good, and _row: by file and row number for a plain read, else by a written copy."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    if docs._jdf.queryExecution().analyzed().children().isEmpty():  # nothing that could repeat rows
        try:
            return docs.select(F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("_place"), row)
        except AnalysisException:  # not of files whose rows are numbered
            pass
    return tables.write(docs.select(F.struct(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("at")).alias("_place"), row))
