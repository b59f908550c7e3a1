"""The paths that only large tables take must give what the simple ones give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import cross_products, impute, quantiles, ranking, segments, similarity, statistics, trends


def words(seed, n):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcde") for _ in range(r.randint(4, 24))) for _ in range(n // 4)]
    found = set(stems)
    while len(found) < n:
        letters = list(r.choice(stems))
        for _ in range(r.randint(1, 3)):
            spot = r.randrange(len(letters))
            if r.random() < 0.3:
                letters.insert(spot, r.choice("abcde"))
            elif r.random() < 0.5 and len(letters) > 2:
                letters.pop(spot)
            else:
                letters[spot] = r.choice("abcde")
        found.add("".join(letters))
    return sorted(found)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(texts, rule):
    pairs = {}
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            longer = max(len(a), len(b))
            share = rule.short_share if longer <= rule.short_length else rule.long_share
            d = distance(a, b)
            if 0 < d <= rule.distance and d / longer <= share:
                pairs[a, b] = d
    return pairs


@pytest.mark.parametrize("rule", [similarity.VALUES, similarity.ROWS])
@pytest.mark.parametrize("frequent", [1000, 3])
def test_close_pairs_equal_brute_force(spark, rule, frequent):
    texts = words(7, 220) + ["customer number %04d" % i for i in range(40)]
    texts = sorted(set(texts))
    items = spark.createDataFrame([(t, t) for t in texts], "id string, text string")
    got = {(r["id_a"], r["id_b"]): r["distance"]
           for r in similarity.close_pairs(items, rule, frequent).collect()}
    assert got == brute(texts, rule)


def test_leaders_in_rounds_equal_the_sequential_pass(spark):
    texts = words(11, 160)
    items = spark.createDataFrame([(t, t, i % 5, t) for i, t in enumerate(texts)],
                                  "id string, text string, rank int, value string")
    pairs = similarity.close_pairs(items, similarity.VALUES)
    near = {}
    for a, b in brute(texts, similarity.VALUES):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    leaders, want = [], {}
    for t in sorted(texts, key=lambda t: (texts.index(t) % 5, t)):
        want[t] = next((x for x in leaders if x in near.get(t, ())), t)
        if want[t] == t:
            leaders.append(t)
    for limit in (10 ** 6, 0):
        got = similarity.leaders(items, pairs, ["rank", "value"], single_task_rows=limit)
        assert {r["id"]: r["leader"] for r in got.collect()} == want


def test_counted_quantiles_equal_the_built_in_ones(spark):
    r = random.Random(3)
    rows = [(r.gauss(0, 1), 5.0 if i % 3 else r.random(), i % 4, None if i % 2 else 1e12 * i)
            for i in range(3000)]
    frame = spark.createDataFrame(rows, "a double, b double, c int, d double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    simple = quantiles.exact_quantiles(frame, frame.columns, probs, built_in_rows=10 ** 9)
    counted = quantiles.exact_quantiles(frame, frame.columns, probs, built_in_rows=0, bins=16)
    # brackets without any margin miss their ranks
    missed = quantiles.exact_quantiles(frame, frame.columns, probs, built_in_rows=0, bins=16, margin=0.0)
    assert counted == missed
    for c in frame.columns:
        assert counted[c] == pytest.approx(simple[c], rel=1e-12)


def test_global_index_with_one_hot_key(spark):
    frame = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("day"), "id")
    small = ranking.global_index(frame, ["day", "id"])
    large = ranking.global_index(frame, ["day", "id"], single_task_rows=0)
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()


def test_carry_fill_across_blocks(spark):
    frame = spark.range(400).select("id", F.when(F.col("id") % 37 == 5, F.col("id")).alias("v"))
    want = []
    last = None
    for i in range(400):
        last = i if i % 37 == 5 else last
        want.append(5 if last is None else last)
    for rows, block in ((10 ** 6, 10 ** 6), (0, 16)):
        filled = ranking.carry_fill(frame, ["v"], ["id"], rows, block)
        assert [r["v"] for r in filled.orderBy("id").collect()] == want


def test_parts_of_an_order_are_bounded_by_rows(spark):
    frame = spark.range(4000).select("id", F.when(F.col("id") % 37 == 5, F.col("id")).alias("v"))
    parts = ranking._in_parts(frame, ["id"], 4000, 100).groupBy(F.spark_partition_id()).count()
    assert parts.count() > 30 and max(r["count"] for r in parts.collect()) < 400
    dated = frame.select("id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("v").cast("int")).alias("v"))
    small, large = (ranking.carry_fill(dated, ["v"], ["id"], rows, 100) for rows in (10 ** 6, 0))
    assert small.exceptAll(large).isEmpty() and large.where("v IS NULL").isEmpty()


def test_trends_and_leader_ranks_do_not_depend_on_the_path(spark):
    frame = spark.range(900).select(
        "id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int"))
        .alias("day"), ((F.col("id") * 37) % 101 + F.col("id") / 9).alias("y"),
        (F.col("id") % 60).alias("shop"))
    in_task = trends.trends(frame, ["id"]).orderBy("value_column").collect()
    in_parts = trends.trends(frame, ["id"], single_task_rows=0).orderBy("value_column").collect()
    assert in_task == in_parts and len(in_task) == 3
    small = segments.volume_value_leaders(frame, "shop", "y").orderBy("segment").collect()
    large = segments.volume_value_leaders(frame, "shop", "y", 7).orderBy("segment").collect()
    assert small == large


def test_segments_of_equal_total_share_a_rank_in_any_order_of_rows(spark):
    rows = [("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", 0.3), ("b", 0.2), ("b", 0.1), ("c", 0.5)]
    frame = spark.createDataFrame(rows, "shop string, y double").coalesce(1)
    ranks = {r["segment"]: r["value_rank"] for r in segments.volume_value_leaders(frame, "shop", "y").collect()}
    assert ranks == {"a": 1, "b": 1, "c": 3}


@pytest.mark.parametrize("first,pairs,frequent", [(7, 10 ** 9, 1000), (10 ** 6, 20, 5), (30, 50, 8)])
def test_leaders_in_batches_equal_the_pass_in_order(spark, first, pairs, frequent):
    rng = random.Random(11)
    texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 12))) for _ in range(140)}
                   | {f"customer {i:05d}" for i in range(0, 400, 7)})
    rng.shuffle(texts)
    rule = similarity.VALUES
    items = spark.createDataFrame([(t, t, i) for i, t in enumerate(texts)], "id string, text string, rank long")
    got = {r.id: r.leader for r in similarity.grouped(items, rule, ["rank"], frequent, first, pairs).collect()}
    close = {}
    for r in similarity.close_pairs(items, rule).collect():
        close.setdefault(r.id_a, set()).add(r.id_b)
        close.setdefault(r.id_b, set()).add(r.id_a)
    expected, leaders = {}, []
    for t in texts:
        expected[t] = next((x for x in leaders if x in close.get(t, ())), t)
        if expected[t] == t:
            leaders.append(t)
    assert got == expected


def test_scopes_never_meet(spark):
    items = spark.createDataFrame([("aaaa1", "aaaaaa", 1, 1), ("aaaa2", "aaaaab", 2, 2), ("aaaa3", "aaaaac", 3, 1)],
                                  "id string, text string, rank long, scope long")
    got = {r.id: r.leader for r in similarity.grouped(items, similarity.VALUES, ["rank"]).collect()}
    assert got == {"aaaa1": "aaaa1", "aaaa2": "aaaa2", "aaaa3": "aaaa1"}


def test_each_pair_is_measured_by_its_own_length(spark):
    long = "x".join(str(i) for i in range(300))
    rows = [(1, "abcdefgh"), (2, "abcdefgi"), (3, long), (4, long + "y"), (5, "zz" * 300)]
    items = spark.createDataFrame(rows, "id long, text string")
    assert sorted(map(tuple, similarity.close_pairs(items, similarity.ROWS).collect())) == [(1, 2, 1), (3, 4, 1)]


def _gappy(spark):
    """Values missing at different rows of two unordered, repeating date columns, one of them all missing."""
    pick = lambda m, r, v: F.when(F.col("id") % m != r, v)
    return spark.range(1200).select(
        "id", pick(11, 3, F.timestamp_micros((F.col("id") * 7919 % 400) * 3_600_000_000 + F.col("id") % 2)).alias("at"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 31 % 90).cast("int")).alias("day"),
        pick(5, 1, F.col("id") * 1.5 + F.col("id") * 37 % 101).alias("y"),
        F.when(F.col("id") * 7919 % 400 > 250, F.col("id") * 7919 % 400 / 3.0).alias("late"),
        F.lit(None).cast("double").alias("none"))


def test_one_sort_per_date_serves_all_measures(spark):
    frame = _gappy(spark).repartition(7)
    for found in (lambda **o: trends.trends(frame, ["id"], values=["y", "late", "none"], **o),
                  lambda **o: trends.forecast_summary(frame, values=["y", "late", "none"], min_r_squared=0.0, **o)):
        in_task, in_parts = (found(**o).orderBy("date_column", "value_column").collect() for o in ({}, {"single_task_rows": 0}))
        assert in_task == in_parts and len(in_task) == 4
    alone = trends.trends(frame, ["id"], ["at"], ["late"], single_task_rows=0).collect()
    assert alone == [r for r in trends.trends(frame, ["id"]).collect() if (r["date_column"], r["value_column"]) == ("at", "late")]


def test_rank_scan_places_and_gaps_equal_a_plain_loop(spark):
    rows = [r.asDict() for r in _gappy(spark).select("id", "y", "late", "none").collect()]
    seen, last = {c: 0 for c in ("y", "late", "none")}, {}
    want = []
    for r in sorted(rows, key=lambda r: r["id"]):
        for c in seen:
            if r[c] is not None:
                want.append((r["id"], c, seen[c], r["id"] - last[c] if c in last else None))
                seen[c], last[c] = seen[c] + 1, r["id"]
    for limit in (10 ** 6, 0):
        got = []
        for r in ranking.rank_scan(_gappy(spark).repartition(5), ["id"], "id", list(seen), limit).collect():
            got += [(r["id"], c, r[f"_x{i}"], r[f"_gap{i}"]) for i, c in enumerate(seen) if r[c] is not None]
            assert [r[f"_n{i}"] for i in range(3)] == list(seen.values())
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [2, 64])
def test_cross_products_equal_plain_correlation(spark, block):
    i = F.col("id")
    frame = spark.range(500).select(
        (i * 37 % 101).cast("double").alias("a"), F.when(i % 7 != 2, i * 1.0).alias("b"),
        F.lit(0.1).alias("fixed"), (i * 0.001 + 1e9).alias("far"), F.when(i == 4, float("inf")).otherwise(i * 53 % 97).alias("endless"),
        F.when(i % 2 == 0, 3.0).otherwise(i * 2.0).alias("fixed_where_even"), F.when(i % 2 == 0, i * i * 1.0).alias("even"),
        F.lit(None).cast("double").alias("none"), F.when(i == 9, 5.0).alias("once")).repartition(6)
    names, rows = frame.columns, frame.collect()
    got = {(r["column_a"], r["column_b"]): r["r"] for r in cross_products.pair_correlations(frame, names, block).collect()}
    pairs = [(a, b) for n, a in enumerate(names) for b in names[n + 1:]]
    assert set(got) <= set(pairs)
    for a, b in pairs:
        both = np.array([(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]).reshape(-1, 2)
        r = got.get((a, b))
        if len(both) < 2 or not np.isfinite(both).all() or (both[0] == both).all(0).any():
            assert r is None or r != r, (a, b)
        else:
            assert abs(r - np.corrcoef(both.T)[0, 1]) < 1e-7, (a, b)


def test_correlations_of_a_constant_column(spark):
    frame = spark.range(40).select(F.col("id").alias("a"), (F.col("id") * -2.0).alias("b"), F.lit(1.5).alias("fixed"))
    found = [(r["column_a"], r["column_b"], r["correlation"]) for r in statistics.correlations(frame).collect()]
    assert found == [("a", "b", -1.0)]


def test_cross_products_of_an_empty_table(spark):
    assert cross_products.pair_correlations(spark.createDataFrame([], "a double, b double"), ["a", "b"]).isEmpty()


def test_a_sampled_forest_has_few_partitions(spark, monkeypatch):
    """Statistics of all nodes are sent per partition, so partitions follow the sample, not the table."""
    class Learner:
        def __init__(self, **options):
            pass

        def fit(self, rows):
            return rows.rdd.getNumPartitions()

    monkeypatch.setattr(impute, "RandomForestClassifier", Learner)
    rows = spark.range(1000).select("id", F.lit(0.0).alias("_y"), F.lit(0.0).alias("features"))
    assert impute._fit(Learner, rows, "id", 10_000_000, 1, impute.ForestOptions()) == 8


def test_a_regression_merges_rows_of_equal_bins(spark):
    """20,000 rows of two numbers learn from at most 64 bins x slices rows that weigh as much."""
    place = F.col("id") % 1000
    frame = spark.range(20_000).select(F.col("id").alias("row_id"), place.alias("x"), (F.col("id") % 2).alias("side"),
                                       F.when(F.col("id") % 7 != 0, place * 2.5 + 100 * (F.col("id") % 2)).alias("size"))
    options = impute.ForestOptions(trees=20, merge_rows=1000)
    learn = frame.where("size is not null").select("row_id", F.col("x").cast("double").alias("f_x"), F.col("side").cast("double").alias("f_side"),
                                                   F.col("size").alias("_y"))
    _, merged = impute._merged(learn, ["f_x", "f_side"], [], "row_id", options)
    facts = merged.agg(F.count("*").alias("n"), F.sum("_weight").alias("weight"), F.sum(F.col("_weight") * F.col("_y")).alias("total")).first()
    total = learn.agg(F.sum("_y")).first()[0]
    assert facts["n"] < 4000 and facts["weight"] == learn.count() and abs(facts["total"] - total) < 1e-6 * total
    filled = impute.forest_impute(frame, "row_id", options)
    assert filled.columns == frame.columns and filled.count() == 20_000
    plain = impute.forest_impute(frame, "row_id", impute.ForestOptions(trees=20))
    error = F.avg(F.abs(F.col("size") - (F.col("row_id") % 1000 * 2.5 + 100 * (F.col("row_id") % 2))))
    assert filled.agg(error).first()[0] < 1.05 * plain.agg(error).first()[0]
    assert filled.join(frame.where("size is not null"), ["row_id", "size"]).count() == learn.count()


@pytest.fixture
def fits(monkeypatch):
    """(kind, rows, their weight, maxBins) of every forest fitted."""
    found = []

    def record(kind):
        fit = kind.fit

        def run(learner, rows):
            weight = F.sum("_weight") if "_weight" in rows.columns else F.count("*")
            n, known = rows.agg(F.count("*"), weight).first()
            found.append((kind, n, known, learner.getMaxBins()))
            return fit(learner, rows)

        monkeypatch.setattr(kind, "fit", run)

    record(impute.RandomForestClassifier)
    record(impute.RandomForestRegressor)
    return found


def test_a_forest_learns_from_all_rows(spark, fits):
    """Trees and bounds of bins come from every known row: labels, blocks of labels, and numbers merged or not."""
    place, gap = F.col("id") % 200, F.col("id") % 7 == 3
    frame = spark.range(33_000).select(
        F.col("id").alias("row_id"), place.alias("x"), (F.col("id") % 13).alias("y"),
        F.when(~gap, F.when(F.col("id") % 6600 < 2, "rare").otherwise("common")).alias("band"),
        F.when(~gap, F.format_string("city%03d", place)).alias("city"), F.when(F.col("id") % 11 != 3, place * 2.5).alias("size"))
    for merge_rows in (1000, 200_000):
        fits.clear()
        filled = impute.forest_impute(frame, "row_id", impute.ForestOptions(trees=5, depth=5, merge_rows=merge_rows))
        assert filled.count() == 33_000 and filled.where("band IS NULL OR city IS NULL OR size IS NULL").isEmpty()
        # band, city's two steps (all rows, then each block of 100 labels), size
        known = {kind: [k for one, _, k, _ in fits if one is kind] for kind, *_ in fits}
        assert known[impute.RandomForestRegressor] == [30_000]
        assert known[impute.RandomForestClassifier][:2] == [28_286, 28_286]
        assert sum(known[impute.RandomForestClassifier][2:]) == 28_286
        # Spark looks for the bounds of bins in this many rows
        assert all(max(bins ** 2, 10_000) >= n for _, n, _, bins in fits)


def test_few_numbers_are_classified_from_all_rows(spark, fits):
    """A rating of a few rows in 30,000 is learned, and predicted where it was lost."""
    rare = F.col("id") % 3000 < 2
    frame = spark.range(30_000).select(
        F.col("id").alias("row_id"), F.when(rare, 500).otherwise(F.col("id") % 50).alias("x"),
        F.when(F.col("id") % 3000 != 1, F.when(rare, 9.5).when(F.col("id") % 50 < 25, 1.0).otherwise(2.0)).alias("rating"))
    filled = impute.forest_impute(frame, "row_id", impute.ForestOptions(trees=20, depth=8, merge_rows=1000))
    assert [(kind, known) for kind, _, known, _ in fits] == [(impute.RandomForestClassifier, 29_990)]
    assert filled.count() == 30_000 and filled.where("row_id % 3000 < 2 AND rating = 9.5").count() == 20
    assert filled.join(frame.where("rating IS NOT NULL"), ["row_id", "rating"]).count() == 29_990


def test_merged_rows_of_a_classifier_keep_every_label(spark):
    """Equal features of two labels stay apart, and a label of one row in 20,000 is learned."""
    learn = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 5).cast("double").alias("f_x"),
                                       F.when(F.col("id") == 77, 2.0).otherwise(F.col("id") % 2).cast("double").alias("_y"))
    _, merged = impute._merged(learn, ["f_x"], [], "row_id", impute.ForestOptions(merge_rows=1000), True)
    found = {r["_y"]: r["n"] for r in merged.groupBy("_y").agg(F.sum("_weight").alias("n")).collect()}
    assert found == {0.0: 10_000, 1.0: 9_999, 2.0: 1} and merged.count() <= 1200


def test_bounds_of_bins_with_infinite_numbers():
    inf = float("inf")
    bounds = impute._edges([-inf, -inf, 1.0, 2.0, 2.0, inf, inf])
    assert bounds[0] == -inf and bounds[-1] == inf and all(a < b for a, b in zip(bounds, bounds[1:]))
    assert {1.0, 2.0} < set(bounds) and len(bounds) == 7
