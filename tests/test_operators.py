"""Guards and regression stories on tiny tables."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tablewright.functions import names
from tablewright.operators import (charts, cleaning, clusters, dedup, impute, periods, profile,
                                   retrieval, statistics, trends)


def test_repeating_ids_never_collapse_rows(spark):
    frame = spark.range(1500).select((F.col("id") % 15).alias("order_id"), F.col("id").alias("v"))
    assert dedup.deduplicate(frame, ["v"]).count() == 1500


def test_trusted_ids_keep_the_first_row_and_all_rows_without_id(spark):
    rows = [(i, float(i)) for i in range(100)] + [(5, 99.0), (None, 1.0), (None, 2.0), (None, 2.0)]
    frame = spark.createDataFrame(rows, "order_id int, v double")
    kept = dedup.deduplicate(frame, ["v"])
    assert kept.where("order_id = 5").first()["v"] == 5.0
    assert kept.where("order_id IS NULL").count() == 2  # the exact copy goes
    report = dedup.retention(frame, kept).first()
    assert (report["rows_removed"], report["warning"]) == (2, False)


def test_ratings_keep_their_own_scale(spark):
    frame = spark.createDataFrame([(1.0, 0.0, 250.0), (88.0, 9.0, 3.0), (None, 4.0, 1.0)],
                                  "csat_score double, nps double, star_rating double")
    scales = {r["column"]: (r["scale_min"], r["scale_max"])
              for r in cleaning.rating_scales(frame).collect()}
    assert scales == {"csat_score": (1.0, 100.0), "nps": (0.0, 10.0), "star_rating": (1.0, 275.0)}


def test_signed_money_is_never_floored(spark):
    frame = spark.createDataFrame([(-5.0, -5.0, 120.0)],
                                  "account_balance double, unit_cost double, discount_pct double")
    row = cleaning.clip_domains(frame).first()
    assert (row["account_balance"], row["unit_cost"], row["discount_pct"]) == (-5.0, 0.0, 100.0)


def test_date_split_rules(spark):
    day = dt.date
    frame = spark.createDataFrame(
        [(day(2024, 1, 1), day(2024, 1, 1), day(2024, 1, 1), 9),
         (day(2024, 1, 9), day(2024, 1, 1), day(1990, 5, 1), 9)],
        "sold date, constant date, birth_date date, sold_year int")
    assert cleaning.split_dates(frame).columns == ["sold", "constant", "birth_date", "sold_year"]
    assert cleaning.date_part_columns(frame) == {"sold": False}


def test_kpis_skip_keys_and_constants(spark):
    frame = spark.range(30).select(F.col("id").alias("order_id"), F.lit(3).alias("same"),
                                   (F.col("id") % 7).alias("width"))
    assert [r["column"] for r in statistics.kpis(frame).collect()] == ["width"]


def test_sum_is_over_present_values_only(spark):
    frame = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "amount double")
    row = statistics.kpis(frame).first()
    assert (row["sum"], row["count"], row["mean"]) == (4.0, 2, 2.0)


def test_status_wording_decides_without_a_lookup(spark):
    frame = spark.createDataFrame([("Delivered", 10.0), ("Refunded", 4.0), (None, 1.0)],
                                  "status string, price double")
    rows = {r["status"]: r for r in statistics.revenue_by_status(frame).collect()}
    assert rows["Delivered"]["reliable_revenue"] == 10.0
    assert rows["Refunded"]["excluded_revenue"] == 4.0
    assert statistics.revenue_by_status(frame.drop("status")) is None


def test_sparse_last_year_is_not_compared(spark):
    rows = [(dt.date(2022, 1 + i % 12, 1), 10.0) for i in range(120)]
    rows += [(dt.date(2023, 1 + i % 12, 1), 11.0) for i in range(120)] + [(dt.date(2024, 1, 1), 1.0)]
    frame = spark.createDataFrame(rows, "day date, v double")
    row = periods.period_changes(frame, "day", ["v"]).first()
    assert (row["yoy_pct_change"], row["excluded_years"], row["last_year"]) == (10.0, "2024", 2023)


def test_spike_month_is_flagged_and_left_out(spark):
    rows = [(dt.date(2023, m, 2), 1.0) for m in range(1, 13) for _ in range(10)]
    rows += [(dt.date(2024, 1, 1), 5.0)] * 500
    frame = spark.createDataFrame(rows, "day date, v double")
    assert [r["period"] for r in periods.volume_anomalies(frame, "day").collect()] == ["2024-01"]
    row = periods.period_changes(frame, "day", ["v"]).first()
    assert row["years_lost_to_volume_anomaly"] == "2024"


def test_direction_follows_the_displayed_change(spark):
    values = [1.0, 1.0, 1.0, 900.0] + [1.0] * 12 + [2.0] * 4
    start = dt.date(2024, 1, 1)
    frame = spark.createDataFrame([(i, start + dt.timedelta(i), v) for i, v in enumerate(values)],
                                  "id int, day date, v double")
    row = trends.trends(frame, ["id"], values=["v"]).first()
    assert (row["direction"], row["slope_direction"], row["direction_conflict"]) == (
        "increasing", "decreasing", True)


def test_forecast_needs_a_line_worth_extending(spark):
    start = dt.date(2024, 1, 1)
    frame = spark.createDataFrame(
        [(start + dt.timedelta(2 * i), 3.0 * i, float(i % 2)) for i in range(20)],
        "day date, up double, noise double")
    rows = trends.forecast(frame, "day", "up").where("type = 'forecast'").orderBy("moment").collect()
    assert [r["value"] for r in rows] == [60.0, 63.0, 66.0, 69.0, 72.0]
    assert rows[0]["moment"].date() == start + dt.timedelta(40)
    assert trends.forecast(frame, "day", "noise").isEmpty()


def test_unit_price_is_not_revenue(spark):
    frame = spark.createDataFrame([("a", 2.0, 90.0, 1), ("b", 3.0, 10.0, 2)],
                                  "shop string, price_per_unit double, total_spent double, n int")
    first = charts.kpi_strip(frame).where("card = 1").first()
    assert (first["title"], first["value"]) == ("TOTAL REVENUE", 100.0)


def test_scorecard_improves_with_cleaning(spark):
    raw = spark.createDataFrame([("ERROR", 1), ("new york", 2), ("new york", 2)], "city string, n int")
    cleaned = spark.createDataFrame([(None, 1), ("New York", 2)], "city string, n int")
    rows = {r["side"]: r for r in profile.scorecard(raw, cleaned).collect()}
    assert rows["after"]["uniqueness_pct"] == 100.0 and rows["before"]["validity_pct"] == 66.7
    assert rows["before"]["delta_points"] > 0


def test_chunks_overlap_and_skip_blanks(spark):
    frame = spark.createDataFrame([("a" * 950,), ("",), (" " * 20,)], "text string")
    sizes = [len(r["text"]) for r in retrieval.chunk_rows(frame, "text", []).collect()]
    assert sizes == [500, 500, 50]


def test_similarity_in_blocks_keeps_every_hit(spark):
    corpus = spark.range(60).select(F.col("id").alias("vec_id"), F.array(
        F.sin(F.col("id")), F.cos(F.col("id")), F.lit(0.3)).cast("array<float>").alias("embedding"))
    queries = corpus.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    whole = retrieval.similar(corpus, queries, 3).orderBy("query_id", "rank").collect()
    parts = retrieval.similar(corpus, queries, 3, query_numbers=6).orderBy("query_id", "rank").collect()
    assert whole == parts and all(r["score"] == 1.0 for r in whole if r["rank"] == 1)


def test_forest_recovers_a_planted_rule(spark):
    frame = spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).alias("side"),
        F.when(F.col("id") % 9 != 0, F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
        .alias("label"), F.when(F.col("id") % 11 != 0, (F.col("id") % 2) * 10.5).alias("size"))
    filled = impute.forest_impute(frame, "row_id", impute.ForestOptions(trees=10))
    wrong = filled.where("label <> IF(row_id % 2 = 0, 'even', 'odd') OR size <> (row_id % 2) * 10.5 "
                         "OR label IS NULL OR size IS NULL")
    assert filled.count() == 400 and wrong.isEmpty()


def test_forest_predicts_any_number_of_labels(spark):
    """300 labels told by two columns; the mode would be right once in 300."""
    place = F.col("id") % 300
    frame = spark.range(3000).select(
        F.col("id").alias("row_id"), F.floor(place / 20).alias("x"), (place % 20).alias("y"),
        F.when(F.col("id") % 7 != 0, F.format_string("city%03d", place)).alias("city"))
    filled = impute.forest_impute(frame, "row_id", impute.ForestOptions(trees=20))
    right = F.col("city") == F.format_string("city%03d", F.col("row_id") % 300)
    assert filled.count() == 3000 and filled.where("city IS NULL").isEmpty()
    assert filled.where(F.col("row_id") % 7 != 0).where(~right).isEmpty()
    assert filled.where(F.col("row_id") % 7 == 0).where(right).count() > 0.9 * 429


def test_clusters_find_planted_groups(spark):
    frame = spark.range(300).select(F.col("id").alias("row_id"),
                                    ((F.col("id") % 3) * 100 + F.rand(1)).alias("x"),
                                    ((F.col("id") % 3) * -50 + F.rand(2)).alias("y"))
    rows, facts = clusters.label_rows(frame, "row_id")
    assert facts["k"] == 3
    assert sorted(r["size"] for r in clusters.segments(frame, "row_id").collect()) == [100] * 3
    noise = rows.groupBy("cluster").agg(F.count_distinct(F.col("row_id") % 3).alias("n"))
    assert noise.where("n <> 1").isEmpty()


def test_cluster_labels_do_not_depend_on_partitions(spark):
    frame = spark.range(900).select(F.col("id").alias("row_id"), *[
        (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 7 + (F.col("id") % 4) * 60 * (i + 1)).alias(f"x{i}") for i in range(3)])
    found = []
    for rows in (frame.repartition(7), frame.coalesce(1).orderBy(F.desc("row_id"))):
        labelled, facts = clusters.label_rows(rows, "row_id", min_silhouette=-1.0)
        found.append((facts, {r.row_id: r.cluster for r in labelled.collect()}))
    assert found[0] == found[1]
    # the silhouette from its definition, over all pairs
    facts, label = found[0]
    values = frame.toPandas().set_index("row_id")[facts["features"]]
    x = ((values - values.mean()) / values.std()).to_numpy()
    own = np.array([label[i] for i in values.index])
    apart = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    inside = np.array([apart[i, own == own[i]].sum() / ((own == own[i]).sum() - 1) for i in range(len(x))])
    outside = np.array([min(apart[i, own == c].mean() for c in set(own) - {own[i]}) for i in range(len(x))])
    assert abs(((outside - inside) / np.maximum(inside, outside)).mean() - facts["silhouette"]) < 0.001
    # every row is with the nearest mean
    means = np.stack([x[own == c].mean(axis=0) for c in range(facts["k"])])
    assert (((x[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1) == own).mean() > 0.998
    assert clusters.label_rows(frame.limit(5), "row_id") is None
    alike = spark.range(40).selectExpr("id as row_id", "id % 2 as x", "id % 2 as y")  # fewer different points than clusters
    assert clusters.label_rows(alike, "row_id")[1]["k"] == 2


def test_fill_widens_whole_numbers_when_the_median_is_fractional(spark):
    frame = spark.createDataFrame([(1,), (2,), (None,)], "stars int")
    assert [r[0] for r in impute.fill_simple(frame).collect()] == [1.0, 2.0, 1.5]


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    frame = spark.range(31).select(F.col("id").alias("v"))
    rows = charts.histogram(frame, "v").collect()
    assert sum(r["count"] for r in rows) == 31 and rows[-1]["bin"] == 29 and rows[-1]["count"] == 2


def test_a_key_of_many_customers_does_not_lead_the_breakdown(spark):
    frame = spark.range(40).select((F.col("id") % 20 * 100_000).alias("o_custkey"), (F.col("id") % 4 + 0.5).alias("price"),
                                   F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    means = {r["category"]: r["mean"] for r in charts.category_breakdown(frame).collect()}
    assert means == {"even": 1.5, "odd": 2.5}
    assert not any(map(names.is_key_name, ("number_of_items", "paid", "width", "total_price")))


def test_cluster_sums_are_exact_beyond_doubles():
    rng = np.random.default_rng(3)
    x = rng.integers(-2 ** 20, 2 ** 20, (500, 4))
    centres = x[:5].astype(float) + 0.3
    assert (clusters._distances(x.astype(float), centres) == np.stack([((x - c) ** 2).sum(axis=1) for c in centres])).all()
    label = clusters._distances(x.astype(float), centres).argmin(axis=0)
    for scale in (1, 2 ** 40 + 1):
        want = [[sum(int(v) * scale for v in x[label == c, j]) for j in range(4)] for c in range(6)]
        assert clusters._totals(x * scale, label, 6) == want
