"""Cases in which cleaning must not lose or change what is right."""

import math
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.quantiles import exact_quantiles
from tablewright.plans.cleaning import CleaningPlan, clean
from tablewright.sources.report_store import ReportStore


def test_ordinary_columns_are_not_identifiers(spark):
    rows = [(f"${i}.50", "By Air" if i % 2 else "By Sea", f"{i}.25", f"{i:05d}", f"opinion {i % 3}") for i in range(100)]
    df = spark.createDataFrame(rows, ["shipping_cost", "shipping_mode", "account_balance", "account_number", "opinion"])
    plan = CleaningPlan.fit(df)
    kinds = {c: p.kind for c, p in plan.columns.items()}
    assert kinds == {"shipping_cost": "number", "shipping_mode": "category", "account_balance": "number", "account_number": "digits",
                     "opinion": "category"}
    first = plan.apply(df).orderBy("account_number").first()
    assert (first.shipping_cost, first.shipping_mode, first.account_balance, first.account_number) == (0.5, "By Sea", 0.25, "00000")


def test_numbered_names_stay_apart(spark):
    df = spark.createDataFrame([(i, f"Customer#{i:09d}") for i in range(400)], "c_custkey long, c_name string")
    assert CleaningPlan.fit(df).apply(df).select("c_name").distinct().count() == 400


def test_any_header_and_renaming_before_duplicates(spark):
    df = spark.createDataFrame([(i % 100, f"t{i % 100}", 1.0 * i) for i in range(104)], "`Order ID` int, `Sr. No.` string, `a``b` double")
    run = clean(df, keep_first=["a`b"])
    assert run.rows.count() == 100 and run.rows.columns == ["order_id", "sr_no", "ab"]
    assert run.plan.apply(df).columns == run.rows.columns


def test_plans_keep_their_own_maps(spark, monkeypatch):
    monkeypatch.setattr("tablewright.plans.cleaning.INLINE_ENTRIES", 0)
    make = lambda a, b: spark.createDataFrame([(a,)] * 50 + [(b,)] * 2, "order_status string")
    one, two = make("delivered", "delivrd"), make("cancelled", "cancelld")
    first, second = CleaningPlan.fit(one), CleaningPlan.fit(two)
    assert first.apply(one).distinct().count() == 1 and second.apply(two).distinct().count() == 1


def test_date_spellings(spark):
    spellings = {"iso": "2024-01-{:02d}T10:00:00", "zone": "2024-01-{:02d}T10:00:00Z", "comma": "Jan {}, 2024", "dash": "{:02d}-Jan-2024",
                 "points": "{:02d}.01.2024", "short": "{:02d}/01/24", "clock": "{:02d}/01/2024 10:30", "half": "{:02d}/01/2024 10:30 AM"}
    for name, spelling in spellings.items():
        df = spark.createDataFrame([(spelling.format(1 + i % 28),) for i in range(60)], "order_date string")
        plan = CleaningPlan.fit(df)
        assert plan.columns["order_date"].kind == "date", name
        found = {r[0].isoformat() for r in plan.apply(df).select("order_date").distinct().collect()}
        assert found == {f"2024-01-{d:02d}" for d in range(1, 29)}, name


def test_quantiles_with_infinities_and_many_magnitudes(spark):
    rng = random.Random(1)
    values = [math.inf, -math.inf, 0.0, -0.0] + [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(3000)] + [1e308, -1e308]
    df = spark.createDataFrame([(v, 5.0) for v in values], "v double, c double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    large = exact_quantiles(df, ["v", "c"], probabilities, built_in_rows=10)
    ordered = sorted(values)
    for p, found in zip(probabilities, large["v"]):
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert found == (low if low == high or at == math.floor(at) else low + (at - math.floor(at)) * (high - low))
    assert large["c"] == [5.0] * 6


def test_store_deletes_names_with_odd_characters(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path / "store"))
    rows = [("one two three", f"user {i}", name, "2024") for i in range(2) for name in ("my data", "a=b/c", "plain")]
    store.add(spark.createDataFrame(rows, "text string, username string, dataset_name string, timestamp string"),
              lambda text: F.array(F.length(text).cast(T.FloatType())))
    assert store.delete("user 0", "my data") == 1 and store.delete("user 0", "a=b/c") == 1
    assert [r[0] for r in store.datasets("user 0").collect()] == ["plain"]
    assert [r[0] for r in store.datasets("user 1").collect()] == ["a=b/c", "my data", "plain"]
