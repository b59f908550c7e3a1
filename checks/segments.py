"""Segment analytics."""

from tablewright.operators import segments

from .statistics import LINEITEM_NUMBERS, kpis_sql
from .tables import table

SEGMENT = """g AS (SELECT c_mktsegment AS segment, sum(o_totalprice) AS total, count(*) AS row_count,
  sum(o_totalprice) / count(*) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"""


def _joined(spark, folder):
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey", "o_custkey", "o_totalprice", "c_mktsegment")


QUERIES = {
    "segment_benchmark": (
        lambda s, d: segments.benchmark(_joined(s, d), "c_mktsegment", "o_totalprice"),
        f"""WITH {SEGMENT} SELECT segment, round(total, 2) AS total, round(mean, 2) AS mean, row_count,
        round(avg(total) OVER (), 2) AS average_segment_total,
        round((total / avg(total) OVER () - 1) * 100, 1) AS total_vs_average_pct,
        round((mean / avg(mean) OVER () - 1) * 100, 1) AS mean_vs_average_pct FROM g"""),
    "per_unit_ratio": (
        lambda s, d: segments.per_unit_ratios(table(s, d, "lineitem"), "l_returnflag",
                                              "l_extendedprice", "l_quantity", "l_discount",
                                              "l_suppkey"),
        """SELECT l_returnflag AS segment, round(sum(l_extendedprice), 2) AS total,
        count(*) AS row_count, round(sum(l_extendedprice) / count(*), 2) AS per_row,
        round(sum(l_extendedprice) / sum(l_quantity), 2) AS per_unit,
        round(sum(l_extendedprice * l_discount) / sum(l_extendedprice) * 100, 1) AS discount_pct,
        count(DISTINCT l_suppkey) AS members,
        round(sum(l_extendedprice) / count(DISTINCT l_suppkey), 2) AS per_member
        FROM lineitem GROUP BY 1"""),
    "skew_gap": (
        lambda s, d: segments.skew_gap(table(s, d, "lineitem")),
        f"""SELECT "column", mean, median, round((mean - median) / nullif(abs(median), 0) * 100, 1)
        AS gap_pct, coalesce(abs((mean - median) / nullif(abs(median), 0)) > 0.15, false) AS notable
        FROM ({kpis_sql('lineitem', LINEITEM_NUMBERS).replace('LIMIT 6', '')})"""),
    "concentration": (
        lambda s, d: segments.concentration(_joined(s, d), "c_mktsegment", "o_totalprice"),
        f"""WITH {SEGMENT} SELECT segment, round(total, 2) AS total,
        round(total / sum(total) OVER () * 100, 1) AS metric_pct,
        round(row_count / CAST(sum(row_count) OVER () AS DOUBLE) * 100, 1) AS row_pct,
        total = max(total) OVER () AND total / sum(total) OVER () * 100 > 40 AS dependency_risk
        FROM g"""),
    "concentration_status": (
        lambda s, d: segments.concentration(table(s, d, "lineitem"), "l_linestatus", "l_quantity"),
        """WITH g AS (SELECT l_linestatus AS segment, sum(l_quantity) AS total, count(*) AS row_count
        FROM lineitem GROUP BY 1) SELECT segment, round(total, 2) AS total,
        round(total / sum(total) OVER () * 100, 1) AS metric_pct,
        round(row_count / CAST(sum(row_count) OVER () AS DOUBLE) * 100, 1) AS row_pct,
        total = max(total) OVER () AND total / sum(total) OVER () * 100 > 40 AS dependency_risk
        FROM g"""),
    "volume_vs_value": (
        lambda s, d: segments.volume_value_leaders(table(s, d, "orders"), "o_custkey",
                                                   "o_totalprice"),
        """WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS segment, sum(o_totalprice) AS total,
        count(*) AS row_count FROM orders GROUP BY 1), r AS (SELECT *,
        rank() OVER (ORDER BY row_count DESC) AS volume_rank,
        rank() OVER (ORDER BY round(total, 2) DESC) AS value_rank FROM g)
        SELECT segment, row_count, round(total, 2) AS total, volume_rank, value_rank,
        volume_rank = 1 AND value_rank = 1 AS leads_both FROM r"""),
    "share_shift_stake": (
        lambda s, d: segments.share_shift_stake(_joined(s, d), "c_mktsegment", "o_totalprice"),
        f"""WITH {SEGMENT}, w AS (SELECT *, sum(total) OVER () AS whole, max(total) OVER () AS top FROM g)
        SELECT segment, round(total / whole * 100, 1) AS share_pct,
        round(top / whole * 100, 1) AS top_share_pct,
        round((top / whole - total / whole) * whole, 2) AS stake FROM w"""),
}
