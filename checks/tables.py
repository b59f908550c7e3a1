"""The parquet tables and the dirty views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIRTY_ORDERS = """
SELECT o_orderkey AS order_id, o_custkey AS customer_ref,
  CASE WHEN o_orderkey % 17 = 0 THEN 'N/A'
       WHEN o_orderkey % 19 = 0 THEN ' unknown '
       WHEN o_orderkey % 5 = 0 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)
       WHEN o_orderkey % 5 = 1 THEN '(' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) || ')'
       WHEN o_orderkey % 5 = 2 THEN CAST(CAST(o_totalprice / 1000 AS DECIMAL(12,1)) AS STRING) || 'k'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END AS total_amount,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL
       ELSE substr(CAST(CAST(o_orderdate AS DATE) AS STRING),9,2) || '-' ||
            substr(CAST(CAST(o_orderdate AS DATE) AS STRING),6,2) || '-' ||
            substr(CAST(CAST(o_orderdate AS DATE) AS STRING),1,4) END AS order_date,
  CASE WHEN o_orderkey % 29 = 0 THEN 'ERROR'
       WHEN o_orderstatus = 'F' THEN (CASE WHEN o_orderkey % 3 = 0 THEN 'delivered' ELSE 'Delivered' END)
       WHEN o_orderstatus = 'O' THEN (CASE WHEN o_orderkey % 11 = 0 THEN 'Canceled' ELSE 'Cancelled' END)
       ELSE (CASE WHEN o_orderkey % 7 = 0 THEN ' PENDING!' ELSE 'Pending' END) END AS order_status,
  CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'N' WHEN 2 THEN 'TRUE' ELSE '0' END AS is_gift,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 10 + 1 AS DOUBLE) END AS order_rating,
  CASE WHEN o_orderkey % 31 = 0 THEN '98x76' ELSE CAST(100000 + o_custkey AS STRING) END AS account_ref,
  CASE WHEN o_orderkey % 37 = 0 THEN CAST(-5 AS DOUBLE) ELSE CAST(o_orderkey % 90 AS DOUBLE) END AS delivery_time_mins
FROM orders"""

DIRTY_EVENTS = """
SELECT event_id, user_id, event_type, value FROM events
UNION ALL SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 50 = 0
UNION ALL SELECT event_id, user_id, event_type, value + 1 FROM events WHERE event_id % 100 = 1
UNION ALL SELECT CAST(NULL AS BIGINT), user_id, event_type, value FROM events WHERE event_id % 200 = 3"""

DIRTY_PARTS = """
SELECT p_partkey,
  CASE WHEN p_partkey % 40 = 0 THEN substr(p_type,1,2) || substr(p_type,4)
       WHEN p_partkey % 41 = 0 THEN lower(p_type)
       WHEN p_partkey % 43 = 0 THEN p_type || 'x' ELSE p_type END AS part_type,
  CASE WHEN p_partkey % 50 = 0 THEN p_name || 's' ELSE p_name END AS part_name,
  p_brand
FROM part"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _view(spark: SparkSession, folder: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", f"FROM parquet.`{folder}/{name}.parquet`"))


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "orders", DIRTY_ORDERS)


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "events", DIRTY_EVENTS)


def dirty_parts(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, "part", DIRTY_PARTS)
