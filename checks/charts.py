"""Chart frames."""

from tablewright.operators import charts

from .tables import DIRTY_ORDERS, dirty_orders, table


def _top(table_name, x, value, k):
    return f"""SELECT {x} AS x, round(CAST({value} AS DOUBLE), 2) AS value FROM {table_name}
WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY CAST({value} AS DOUBLE) DESC, 1 LIMIT {k}"""


def _histogram_sql(table_name, x):
    return f"""WITH b AS (SELECT min({x}) AS lo, max({x}) AS hi, round(avg({x}), 2) AS mean
  FROM {table_name}), v AS (SELECT CAST(least(floor(({x} - lo) / ((hi - lo) / 30)), 29) AS INTEGER)
  AS bin, lo, (hi - lo) / 30 AS width, mean FROM {table_name}, b)
SELECT bin, round(lo + bin * width, 4) AS bin_start, round(lo + (bin + 1) * width, 4) AS bin_end,
  count(*) AS count, mean FROM v GROUP BY bin, lo, width, mean"""


def _rollup_sql(table_name, date, value):
    return f"""WITH m AS (SELECT year({date}) AS y, month({date}) AS m, sum({value}) AS v
  FROM {table_name} GROUP BY 1, 2), a AS (SELECT count(DISTINCT y) > 2 AS annual FROM m)
SELECT CASE WHEN annual THEN CAST(y AS VARCHAR) ELSE printf('%d-%02d', y, m) END AS label,
  CASE WHEN annual THEN 'annual' ELSE 'monthly' END AS granularity, round(sum(v), 2) AS total
FROM m, a GROUP BY 1, 2"""


LOOSE = "TRY_CAST(regexp_replace(total_amount, '[^0-9.\\-]', '', 'g') AS DOUBLE)"

BREAKDOWN = """WITH q AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS category,
    avg(o_totalprice) AS v FROM orders GROUP BY 2
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, avg(o_totalprice) FROM orders GROUP BY 2)
SELECT "column", category, round(v, 2) AS mean FROM q
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY v DESC, category) <= 10"""

MONEY = """CASE WHEN {v} >= 1e9 THEN '$' || format('{{:,.2f}}', {v} / 1e9) || 'B'
  WHEN {v} >= 1e6 THEN '$' || format('{{:,.2f}}', {v} / 1e6) || 'M'
  WHEN {v} >= 1e3 THEN '$' || format('{{:,.1f}}', {v}) ELSE '$' || format('{{:,.2f}}', {v}) END"""


def _money(value):
    return MONEY.format(v=value)


STRIP = f"""WITH o AS (SELECT o_orderstatus AS segment, o_totalprice AS total_price FROM orders),
k AS (SELECT round(sum(total_price), 2) AS sum, round(avg(total_price), 2) AS mean,
  round(median(total_price), 2) AS median, count(*) AS n, sum(total_price) AS exact FROM o),
t AS (SELECT segment, sum(total_price) AS part FROM o WHERE segment = (SELECT segment FROM o
  GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1) GROUP BY 1)
SELECT 1 AS card, 'TOTAL REVENUE' AS title, sum AS value, {_money('sum')} AS shown,
  CAST(NULL AS VARCHAR) AS caption FROM k
UNION ALL SELECT 2, 'AVG ORDER VALUE', mean, {_money('mean')}, 'Median ' || {_money('median')} FROM k
UNION ALL SELECT 3, 'TOTAL ORDERS', CAST(n AS DOUBLE), format('{{:,}}', n), 'Records analyzed' FROM k
UNION ALL SELECT 4, 'TOP ORDER STATUS', round(part, 2), segment, {_money('part')} || ' · '
  || printf('%.1f', round(part / exact * 100, 1)) || '% of price' FROM t, k"""


def _strip(spark, folder):
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderstatus AS order_status",
        "o_totalprice AS total_price", "o_orderpriority AS priority")
    return charts.kpi_strip(orders, "Orders")


QUERIES = {
    "chart_pie": (
        lambda s, d: charts.pie(table(s, d, "orders"), "o_orderpriority", "o_totalprice"),
        _top("orders", "o_orderpriority", "sum(o_totalprice)", 8)),
    "chart_pie_counts": (
        lambda s, d: charts.pie(table(s, d, "part"), "p_brand"),
        _top("part", "p_brand", "count(*)", 8)),
    "chart_bar": (
        lambda s, d: charts.bar(table(s, d, "part"), "p_brand", "p_retailprice"),
        _top("part", "p_brand", "avg(p_retailprice)", 12)),
    "chart_column": (
        lambda s, d: charts.column(table(s, d, "part"), "p_name", "p_retailprice"),
        _top("part", "p_name", "avg(p_retailprice)", 15)),
    "chart_column_text_number": (
        lambda s, d: charts.column(dirty_orders(s, d), "is_gift", "total_amount"),
        _top(f"({DIRTY_ORDERS}) t", "is_gift", f"avg({LOOSE})", 15)),
    "chart_stacked": (
        lambda s, d: charts.stacked_bar(table(s, d, "orders"), "o_orderpriority",
                                        "o_orderstatus", "o_totalprice"),
        """SELECT o_orderpriority AS x, o_orderstatus AS color, round(sum(o_totalprice), 2) AS value
        FROM orders GROUP BY 1, 2"""),
    "chart_stacked_counts": (
        lambda s, d: charts.stacked_bar(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"),
        """SELECT l_returnflag AS x, l_linestatus AS color, CAST(count(*) AS DOUBLE) AS value
        FROM lineitem GROUP BY 1, 2"""),
    "chart_line": (
        lambda s, d: charts.line(table(s, d, "orders"), "o_orderdate", "o_totalprice"),
        """SELECT o_orderdate AS x, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1"""),
    "chart_line_colored": (
        lambda s, d: charts.line(table(s, d, "lineitem"), "l_shipdate", "l_quantity",
                                 "l_returnflag"),
        """SELECT l_shipdate AS x, l_returnflag AS color, round(avg(l_quantity), 6) AS value
        FROM lineitem GROUP BY 1, 2"""),
    "chart_histogram": (
        lambda s, d: charts.histogram(table(s, d, "lineitem"), "l_extendedprice"),
        _histogram_sql("lineitem", "l_extendedprice")),
    "chart_scatter_sample": (
        lambda s, d: charts.scatter(table(s, d, "orders"), "o_custkey", "o_totalprice",
                                    ["o_orderkey"]),
        """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders
        ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 3000"""),
    "chart_scatter_fit": (
        lambda s, d: charts.scatter_line(table(s, d, "lineitem"), "l_quantity",
                                         "l_extendedprice"),
        """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b,
          regr_intercept(l_extendedprice, l_quantity) AS a, min(l_quantity) AS lo,
          max(l_quantity) AS hi FROM lineitem)
        SELECT CAST(i AS INTEGER) AS point, round(lo + (hi - lo) / 49 * i, 4) AS x,
          round(a + b * (lo + (hi - lo) / 49 * i), 4) AS y FROM f, range(50) t(i)"""),
    "trend_rollup": (
        lambda s, d: charts.trend_rollup(table(s, d, "orders"), "o_orderdate", "o_totalprice"),
        _rollup_sql("orders", "o_orderdate", "o_totalprice")),
    "trend_rollup_monthly": (
        lambda s, d: charts.trend_rollup(table(s, d, "events"), "ts", "value"),
        _rollup_sql("events", "ts", "value")),
    "category_breakdown": (
        lambda s, d: charts.category_breakdown(table(s, d, "orders")), BREAKDOWN),
    "kpi_strip": (_strip, STRIP),
}
