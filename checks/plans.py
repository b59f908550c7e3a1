"""The fitted plan end to end, and the statistics package built on its result."""

import uuid

from pyspark.sql import functions as F

from tablewright.plans.cleaning import clean
from tablewright.plans.report import full_report, value_rows
from tablewright.session import shared_folder

from .cleaning import cleaned, number, parsed_date, swept, title, yes_no
from .periods import _monthly_sql as monthly_sql
from .statistics import KEYWORDS, QUALITY_SQL, STATUS_SQL, kpis_sql
from .statistics import _category_sql as category_sql
from .tables import DIRTY_ORDERS, dirty_orders, table

SOURCE = f"""s AS (SELECT order_id, customer_ref, {number('total_amount')} AS amount,
  {parsed_date('order_date')} AS day, {title(cleaned(swept('order_status')))} AS status,
  {yes_no('is_gift')} AS gift, order_rating AS rating, delivery_time_mins AS mins,
  CASE WHEN NOT regexp_matches(account_ref, '[^0-9]') THEN account_ref END AS account,
  total_amount, order_status FROM ({DIRTY_ORDERS})),
m AS (SELECT * REPLACE (CASE status WHEN 'Canceled' THEN 'Cancelled' ELSE status END AS status)
  FROM s),
f AS (SELECT (SELECT median(amount) FROM m) AS amount, (SELECT median(rating) FROM m) AS rating,
  (SELECT status FROM m WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS status,
  (SELECT account FROM m WHERE account IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    AS account)"""

CLEAN_SQL = f"""WITH {SOURCE},
a AS (SELECT order_id, customer_ref, greatest(coalesce(m.amount, f.amount), 0) AS total_amount, coalesce(
    last_value(day IGNORE NULLS) OVER (ORDER BY order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(day IGNORE NULLS) OVER (ORDER BY order_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS order_date,
  coalesce(m.status, f.status) AS order_status, gift AS is_gift,
  least(greatest(coalesce(m.rating, f.rating), 1), 10) AS order_rating,
  coalesce(m.account, f.account) AS account_ref, greatest(mins, 0) AS delivery_time_mins FROM m, f)
SELECT *, CAST(year(order_date) AS INTEGER) AS order_date_year,
  CAST(month(order_date) AS INTEGER) AS order_date_month,
  monthname(order_date) AS order_date_month_name FROM a"""

LOG_SQL = f"""WITH {SOURCE}, c AS (SELECT
  count(*) FILTER (WHERE regexp_matches(total_amount, '[₹$€£¥₩]')) AS signs,
  count(amount) AS numbers, count(*) FILTER (WHERE amount IS NULL) AS no_amount,
  count(*) FILTER (WHERE rating IS NULL) AS no_rating,
  count(*) FILTER (WHERE status IS NULL) AS no_status,
  count(*) FILTER (WHERE account IS NULL) AS no_account, count(*) FILTER (WHERE day IS NULL) AS no_day,
  count(*) FILTER (WHERE mins < 0) AS below, count(gift) AS gifts,
  count(*) FILTER (WHERE amount < 0) AS negative FROM m),
k AS (SELECT count(*) AS merged FROM s WHERE status = 'Canceled')
SELECT step, "column", action, n_cells FROM c, k, LATERAL (VALUES
  ('duplicates', NULL, 'rows removed', 0), ('currency', 'total_amount', 'symbols stripped', signs),
  ('types', 'total_amount', 'to number', numbers),
  ('ids', 'account_ref', 'corrupted set to null', no_account),
  ('types', 'order_date', 'to date', NULL),
  ('categories', 'order_status', 'spellings merged', merged),
  ('booleans', 'is_gift', 'to Yes/No', gifts), ('scales', 'order_rating', 'inferred', NULL),
  ('missing', 'total_amount', 'filled', no_amount), ('missing', 'order_rating', 'filled', no_rating),
  ('missing', 'order_date', 'filled from neighbours', no_day), ('missing', 'order_status', 'filled', no_status), ('missing', 'account_ref', 'filled', no_account),
  ('bounds', 'total_amount', 'clipped', negative), ('bounds', 'delivery_time_mins', 'clipped', below)
) t(step, "column", action, n_cells)"""


def _clean(s, d):
    return clean(dirty_orders(s, d))


def _report(s, d):
    """Section names and sizes of the whole package over orders."""
    orders = table(s, d, "orders")
    report = full_report(orders, ["o_orderkey"])
    sizes = None
    for name, frame in report.items():
        counted = frame.agg(F.lit(name).alias("section"), F.count("*").alias("n_rows"))
        sizes = counted if sizes is None else sizes.unionByName(counted)
    return sizes


def _long(section, sql, texts, numbers):
    """The numbers of a section's SQL as section, item, measure, value."""
    item = ", ".join(f'CAST("{c}" AS VARCHAR)' for c in sorted(texts))
    cast = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in numbers)
    return f"""SELECT '{section}' AS section, item, measure, value FROM (UNPIVOT (
  SELECT concat_ws(' / ', {item}) AS item, {cast} FROM ({sql})) ON COLUMNS(* EXCLUDE (item)) INTO NAME measure VALUE value)"""


TEXT = ["o_orderstatus", "o_orderpriority"]
MEASURES = ["o_custkey", "o_totalprice"]
REPORT = {
    "quality_score": (QUALITY_SQL, ["grade"], ["overall_score", "completeness_pct", "uniqueness_pct", "validity_pct", "missing_cells", "duplicate_rows"]),
    "kpis": (kpis_sql("orders", ["o_orderkey", *MEASURES]), ["column"], ["mean", "median", "std", "min", "max", "sum", "count", "coefficient_of_variation"]),
    "category_summary": (category_sql("orders", TEXT, 5), ["column", "value"], ["unique_values", "rank", "count", "pct"]),
    "revenue_by_status": (STATUS_SQL.format(completed=f"NOT regexp_matches(lower(status), '{KEYWORDS}')", join=""), ["status", "is_completed"],
                          ["revenue", "count", "pct_of_total_revenue", "total_revenue", "reliable_revenue", "excluded_revenue"]),
    "monthly_totals:o_orderdate": (monthly_sql("orders", "o_orderdate", MEASURES),
                                   ["date_column", "value_column", "month_name", "year_month", "label", "is_volume_anomaly"],
                                   ["year", "month", "total", "avg", "count"]),
}


def _report_values(s, d):
    """All numbers of the sections that have SQL."""
    report = full_report(table(s, d, "orders"), ["o_orderkey"])
    return value_rows({name: report[name] for name in REPORT})


def _stored(s, d):
    """A stored table cleaned without any key: dates follow the rows of its files."""
    path = f"{shared_folder(s)}/dirty-{uuid.uuid4().hex}"
    dirty_orders(s, d).select("order_id", "order_date").coalesce(1).write.parquet(path)
    return clean(s.read.parquet(path)).rows.select("order_id", "order_date")


QUERIES = {
    "clean_stored_dates": (_stored, f"SELECT order_id, order_date FROM ({CLEAN_SQL})"),
    "report_values": (_report_values, "\nUNION ALL ".join(_long(n, *x) for n, x in REPORT.items())),
    "clean_orders": (lambda s, d: _clean(s, d).rows, CLEAN_SQL),
    "cleaning_log": (
        lambda s, d: _clean(s, d).log.select("step", "column", "action", "n_cells"), LOG_SQL),
    "full_report": (_report, None),
}
