"""Cell rewrites, one literal case each."""

import datetime as dt

from pyspark.sql import functions as F

from tablewright.functions import cells, dates, edits, names
from tablewright.functions.accents import normalise_text
from tablewright.functions.counts import value_counts
from tablewright.session import spread


def one(spark, value, expression):
    frame = spark.createDataFrame([(value,)], "c string")
    return frame.select(expression(F.col("c"))).first()[0]


def test_numbers(spark):
    cases = {"₹1,200": 1200.0, "(123.45)": -123.45, "5k": 5000.0, "3.2M": 3.2e6, "12%": 12.0,
             "+7": 7.0, "(5k)": -5000.0, "1e3": 1000.0, ".5": 0.5, "ERROR": None, "#DIV/0!": None,
             "1d": None, "NaN": None, "0x1p3": None, "inf": None, "-": None, "": None,
             "98x76": None, "1e3k": None}
    frame = spark.createDataFrame([(k, v) for k, v in cases.items()], "c string, want double")
    rows = frame.withColumn("got", cells.parse_number(F.col("c"))).collect()
    assert {r["c"]: r["got"] for r in rows} == cases


def test_null_markers_are_trimmed_and_case_blind(spark):
    assert one(spark, "  N/a ", cells.sweep_nulls) is None
    assert one(spark, "none of it", cells.sweep_nulls) == "none of it"


def test_text_cleaning(spark):
    assert one(spark, "Café-Bar ​ x—y", cells.clean_text) == "Café Bar x y"
    assert one(spark, " .,; ", cells.clean_text) is None
    assert one(spark, "R&D $5", cells.clean_text) == "R&D $5"


def test_boolean_words(spark):
    assert [one(spark, v, cells.yes_no) for v in ("y", " OFF ", "maybe")] == ["Yes", "No", "maybe"]


def test_clip_keeps_nulls(spark):
    frame = spark.createDataFrame([(None,), (-1.0,), (7.0,)], "v double")
    got = [r[0] for r in frame.select(cells.clip(F.col("v"), 0.0, 5.0)).collect()]
    assert got == [None, 0.0, 5.0]


def test_display_values(spark):
    frame = spark.createDataFrame([(None,), (12.5,), (1234.56,), (-2.5e6,), (3e9,)], "v double")
    got = [r[0] for r in frame.select(cells.format_value(F.col("v"), "$")).collect()]
    assert got == ["N/A", "$12.50", "$1,234.6", "$-2.50M", "$3.00B"]


def test_accents_are_removed_for_comparison(spark):
    assert one(spark, "  Ｃafé—№1! ", normalise_text) == "cafe no1"


def test_date_spellings(spark):
    formats = dates.ladder(True)
    for text, want in {"31-12-2024": dt.date(2024, 12, 31), "5 Jan 2024": dt.date(2024, 1, 5),
                       "20241231": dt.date(2024, 12, 31), "2024/12/31": dt.date(2024, 12, 31),
                       "13-13-2024": None}.items():
        assert one(spark, text, lambda c: dates.parse_date(c, formats)) == want
    for text, want in {"Jan-2024": dt.date(2024, 1, 1), "2024 Jan": dt.date(2024, 1, 1),
                       "03/2024": dt.date(2024, 3, 1), "Jan-75": dt.date(1975, 1, 1),
                       "Jan 24": dt.date(2024, 1, 1)}.items():
        assert one(spark, text, dates.parse_month_year) == want


def test_ratings_and_durations_are_not_dates(spark):
    frame = spark.createDataFrame([("1.4", "16"), ("3.2", "47"), ("4.1", "69")],
                                  "order_rating_date string, delivery_time_mins string")
    fits = dates.fit_dates(frame, frame.columns)
    assert fits["order_rating_date"].formats() is None
    assert not fits["delivery_time_mins"].is_candidate


def test_mixed_date_spellings_are_accepted_together(spark):
    values = ["31-12-2024", "2024-05-06", "5 Jan 2024", "Mar-2024"]
    frame = spark.createDataFrame([(v,) for v in values], "order_date string")
    fit = dates.fit_dates(frame, ["order_date"])["order_date"]
    assert fit.day_first and len(fit.formats()) > 1


def test_names():
    assert names.has_word("order_at", ["at"]) and not names.has_word("order_rating", ["at"])
    assert names.standard_names([" A b ", "a-b", "a_b", "!"]) == ["a_b", "ab", "a_b_2", "column"]
    assert not names.is_revenue_name("price_per_unit") and names.is_revenue_name("total_price")
    assert names.business_label("total_revenue") == ("Revenue", "$")
    assert names.business_columns(["a", "d_year", "row_number", "x_id"]) == ["a"]
    assert names.is_digit_identifier("account_ref") and not names.is_digit_identifier("sku")


def test_bounded_edit_distance():
    assert edits._within("kitten", "sitting", 3) == 3
    assert edits._within("kitten", "sitting", 2) == -1
    assert edits._within("a" * 5000 + "x" + "b" * 5000, "a" * 5000 + "b" * 5000, 1) == 1


def test_only_formats_of_a_fitting_shape_are_tried(spark):
    frame = spark.createDataFrame([("31-12-2024", "5 Jan 2024"), (" 7-1-2023", "Mar-2024"), (None, "x")], "a string, b string")
    fitting = dates.fitting_formats(value_counts(frame, ["a", "b"]))
    assert set(fitting["a"]) == {"d-M-yyyy", "M-d-yyyy"}
    assert set(fitting["b"]) == {"d MMM yyyy", "d MMMM yyyy", "MMM-yyyy", "MMMM-yyyy"}


def test_rows_are_spread_before_a_plan_is_fitted(spark):
    whole = spark.range(100_000).select(F.col("id").cast("string").alias("a")).coalesce(1)
    counts = [r["count"] for r in spread(whole).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 100_000 and len(counts) > 1
