"""Cleaning must keep what is right: numbered names, money named like an identifier, odd headers, dates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.plans.cleaning import CleaningPlan, clean
from tablewright.session import shared_folder
from tablewright.sources import csv_files
from tablewright.sources.report_store import ReportStore

from .tables import table


def _shipping(s, d):
    """Columns whose names hold fragments of identifiers."""
    return table(s, d, "orders").select(
        "o_orderkey", F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("shipping_cost"),
        F.when(F.col("o_orderkey") % 2 == 0, "By Air").otherwise("By Sea").alias("shipping_mode"),
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("account_number"))


def _shipped(s, d):
    frame = _shipping(s, d)
    plan = CleaningPlan.fit(frame)
    return plan._typed(plan_input(plan, frame)).select("o_orderkey", "shipping_cost", "shipping_mode", "account_number")


def plan_input(plan, frame):
    return frame.select(*[F.col(p.source).alias(c) for c, p in plan.columns.items()])


def _headers(s, d):
    """Raw headers with spaces and points, and ids that repeat."""
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("Order ID"), F.col("o_orderstatus").alias("Sr. No."))
    repeated = orders.where("`Order ID` % 40 = 0").withColumn("Sr. No.", F.concat(F.lit("A"), "`Sr. No.`"))
    return orders.unionByName(repeated)  # the repeats differ and come first in order of their cells


SPELLINGS = {
    "iso_date": "yyyy-MM-dd'T'HH:mm:ss", "zone_date": "yyyy-MM-dd'T'HH:mm:ss'Z'", "comma_date": "MMM d, yyyy", "dash_date": "dd-MMM-yyyy",
    "point_date": "dd.MM.yyyy", "clock_date": "dd/MM/yyyy HH:mm", "half_date": "MM/dd/yyyy hh:mm a",
}


def _dates(s, d):
    """Every order date in each spelling, read back."""
    orders = table(s, d, "orders")
    spelled = orders.select("o_orderkey", *[F.date_format("o_orderdate", f).alias(c) for c, f in SPELLINGS.items()])
    plan = CleaningPlan.fit(spelled, fuzzy=False)
    return plan._typed(plan_input(plan, spelled)).select("o_orderkey", *SPELLINGS)


def _store(s, d):
    """Add reports, delete one dataset whose name holds odd characters, list what is left."""
    store = ReportStore(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}")
    reports = table(s, d, "nation").select(
        F.col("n_name").alias("text"), F.format_string("user %d", "n_regionkey").alias("username"),
        F.format_string("a=b/ %d", F.col("n_nationkey") % 2).alias("dataset_name"), F.lit("2024").alias("timestamp"))
    store.add(reports, lambda text: F.array(F.length(text).cast(T.FloatType())))
    store.delete("user 0", "a=b/ 0")
    return store.table().groupBy("username", "dataset_name").agg(F.count("*").alias("chunks"))


def _sheet(s):
    """A file of cells with quotes, commas and line breaks, as written by the CSV sink."""
    path = f"{shared_folder(s)}/sheet-{uuid.uuid4().hex}"
    return path


def _csv_text(s, d):
    """Written and read back as text."""
    path = _sheet(s)
    csv_files.write_csv(table(s, d, "orders").select(
        "o_orderkey", "o_orderstatus", F.concat(F.lit(" a, "), "o_orderpriority", F.lit(' "x"')).alias("note")), path)
    return csv_files.stage_text_csv(s, path)[0]


def _csv_broken_cells(s, d):
    """Cells that run over lines."""
    path = _sheet(s)
    csv_files.write_csv(table(s, d, "orders").select(
        "o_orderkey", F.concat("o_orderstatus", F.lit(' said "no",\n'), "o_orderpriority").alias("note")), path)
    return csv_files.stage_text_csv(s, path)[0]


def _csv_typed(s, d):
    path = _sheet(s)
    csv_files.write_csv(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return csv_files.read_typed_csv(s, path).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_acctbal")


def _sink_and_preview(s, d):
    path = _sheet(s)
    csv_files.write_parquet(table(s, d, "nation"), path, partition_by=["n_regionkey"])
    return csv_files.preview(s.read.parquet(path), 7, ["n_name"]).select("n_name", "n_nationkey", F.col("n_regionkey").cast("int").alias("n_regionkey"))


QUERIES = {
    "csv_text": (_csv_text, """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, ' a, ' || o_orderpriority || ' "x"' AS note FROM orders"""),
    "csv_broken_cells": (_csv_broken_cells, """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
        o_orderstatus || ' said "no",' || chr(10) || o_orderpriority AS note FROM orders"""),
    "csv_typed": (_csv_typed, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "sink_and_preview": (_sink_and_preview, "SELECT n_name, n_nationkey, n_regionkey FROM nation ORDER BY n_name LIMIT 7"),
    "clean_customer_names": (
        lambda s, d: clean(table(s, d, "customer")).rows.select("c_custkey", "c_name"), "SELECT c_custkey, replace(c_name, '#', ' ') AS c_name FROM customer"),
    "clean_shipping": (_shipped, """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS shipping_cost,
        CASE WHEN o_orderkey % 2 = 0 THEN 'By Air' ELSE 'By Sea' END AS shipping_mode, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS account_number
        FROM orders"""),
    "clean_raw_headers": (
        lambda s, d: clean(_headers(s, d)).rows.select("order_id", "sr_no"), "SELECT o_orderkey AS order_id, o_orderstatus AS sr_no FROM orders"),
    "parse_dates_general": (_dates, "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderdate AS DATE) AS {c}" for c in SPELLINGS) + " FROM orders"),
    "store_add_delete": (_store, """SELECT 'user ' || n_regionkey AS username, 'a=b/ ' || (n_nationkey % 2) AS dataset_name, count(*) AS chunks
        FROM nation WHERE NOT (n_regionkey = 0 AND n_nationkey % 2 = 0) GROUP BY 1, 2"""),
}
