"""Plans, sources, the report store and the landing stream."""

import pytest
from pyspark.sql import functions as F

from tablewright.plans.cleaning import CleaningPlan, clean
from tablewright.plans.report import full_report
from tablewright.sources import csv_files
from tablewright.sources.report_store import ReportStore
from tablewright.streaming.landing import clean_landing

ROWS = [(f" {i} ", f"${i * 10}" if i % 4 else "N/A", f"{1 + i % 28:02d}-0{1 + i % 9}-2024",
         ["Delivered", "delivered", "Delivrd", "Pending", "ERROR"][i % 5],
         ["yes", "N"][i % 2], "12a" if i % 20 == 7 else str(5550000 + i)) for i in range(60)]
COLUMNS = ["Order ID", "Total Amount", "Order Date", "Order Status", "Is Gift", "Phone"]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def cleaned(messy):
    return clean(messy)


def test_plan_decides_and_applies(cleaned):
    kinds = {c: p.kind for c, p in cleaned.plan.columns.items()}
    assert kinds == {"order_id": "number", "total_amount": "number", "order_date": "date",
                     "order_status": "category", "is_gift": "boolean", "phone": "digits"}
    types = dict(cleaned.rows.dtypes)
    assert types["order_date"] == "date" and types["order_id"] == "bigint"
    assert {"order_date_year", "order_date_month", "order_date_month_name"} <= set(types)
    rows = cleaned.rows.collect()
    assert {r["order_status"] for r in rows} == {"Delivered", "Pending"}
    assert {r["is_gift"] for r in rows} == {"Yes", "No"}
    assert all(r["total_amount"] is not None and r["phone"].isdigit() for r in rows)
    assert len(rows) == 60 and cleaned.retention.first()["retention_pct"] == 100.0


def test_log_counts_cells(cleaned):
    log = {(r["step"], r["column"]): r["n_cells"] for r in cleaned.log.collect()}
    assert log["missing", "total_amount"] == 15 and log["ids", "phone"] == 3
    assert log["booleans", "is_gift"] == 60


def test_plan_survives_json_and_is_idempotent(messy, cleaned):
    again = CleaningPlan.from_json(cleaned.plan.to_json())
    first, second = again.apply(messy), cleaned.plan.apply(messy)
    assert first.exceptAll(second).isEmpty()
    twice = CleaningPlan.fit(first.drop("order_date_year", "order_date_month",
                                        "order_date_month_name")).apply(first)
    assert twice.select("order_id", "order_status", "total_amount").exceptAll(
        first.select("order_id", "order_status", "total_amount")).isEmpty()


def test_supplied_names_come_before_spelling(spark, messy):
    lookup = spark.createDataFrame([("order_status", "Pending", "Open")],
                                   "column string, dirty string, canonical string")
    rows = clean(messy, canonical=lookup).rows
    assert {r[0] for r in rows.select("order_status").distinct().collect()} == {"Delivered", "Open"}


def test_report_has_every_section(cleaned):
    report = full_report(cleaned.rows.drop("phone"), ["order_id"])
    assert {"quality_score", "kpis", "trends", "best_trend", "best_forecast", "correlations",
            "anomalies", "category_summary", "revenue_by_status", "kpi_strip",
            "monthly_totals:order_date", "period_changes:order_date"} <= set(report)
    assert report["revenue_by_status"].count() == 2


def test_csv_round_trip_keeps_bad_rows_apart(spark, messy, tmp_path):
    path = str(tmp_path / "out")
    csv_files.write_csv(messy, path)
    good, bad = csv_files.stage_text_csv(spark, path)
    assert good.count() == 60 and bad.isEmpty() and good.exceptAll(messy).isEmpty()
    broken = tmp_path / "bad.csv"
    broken.write_text("a,b\n1,2\n1,2,3,4\n5,6\n")
    good, bad = csv_files.stage_text_csv(spark, str(broken))
    assert bad.first()[0] == "1,2,3,4" and good.count() == 2
    assert csv_files.read_typed_csv(spark, str(broken)).count() == 3
    assert csv_files.preview(messy, 3, ["Order ID"]).count() == 3


def test_report_store(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path / "reports"))
    reports = spark.createDataFrame(
        [("x" * 700 + "y" * 300, "ann", "sales", "t1"), ("y" * 400, "ann", "costs", "t1"),
         ("x" * 100, "bob", "sales", "t1")], "text string, username string, dataset_name string, "
        "timestamp string")

    def embed(c):
        return F.array(F.length(F.replace(c, F.lit("y"), F.lit(""))),
                       F.length(F.replace(c, F.lit("x"), F.lit(""))))

    assert store.add(reports, embed) == 5
    ids = [r["id"] for r in store.of("ann", "sales").orderBy("chunk_index").collect()]
    assert ids == [f"ann__sales__t1__chunk{i}" for i in range(3)]
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, embedding array<float>")
    best = store.query(queries, "ann", k=2).orderBy("rank").collect()
    assert best[0]["score"] == 1.0 and all(r["dataset_name"] in ("sales", "costs") for r in best)
    assert [r[0] for r in store.datasets("ann").collect()] == ["costs", "sales"]
    assert store.delete("ann", "sales") == 3
    spark.catalog.clearCache()
    assert [r[0] for r in store.datasets("ann").collect()] == ["costs"]
    assert store.of("bob").count() == 1 and store.delete("ann", "sales") == 0


def test_landing_files_are_cleaned_once(spark, messy, cleaned, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    csv_files.write_csv(messy, folder)
    for _ in range(2):
        clean_landing(spark, cleaned.plan, folder, target, tmp_path.name).awaitTermination(120)
    rows = spark.read.parquet(target)
    assert rows.count() == 60 and rows.exceptAll(cleaned.rows).isEmpty()
