"""Calendar comparisons, trends and forecasts."""

from pyspark.sql import functions as F

from tablewright.operators import periods, trends

from .tables import table

ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _months(table_name, date, values):
    union = "\nUNION ALL ".join(
        f"SELECT year({date}) AS year, month({date}) AS month, '{v}' AS value_column, "
        f"sum(CAST({v} AS DOUBLE)) AS s, count({v}) AS n FROM {table_name} "
        f"WHERE {date} IS NOT NULL GROUP BY 1, 2" for v in values)
    return f"""c AS (SELECT year({date}) AS year, month({date}) AS month, count(*) AS row_count
  FROM {table_name} WHERE {date} IS NOT NULL GROUP BY 1, 2),
z AS (SELECT *, (row_count - avg(row_count) OVER ()) / nullif(stddev_pop(row_count) OVER (), 0)
    AS z_score, count(*) OVER () AS periods, (sum(row_count) OVER () - sum(row_count) OVER
    (PARTITION BY row_count)) / nullif(count(*) OVER () - count(*) OVER (PARTITION BY row_count), 0)
    AS others FROM c),
f AS (SELECT *, periods >= 4 AND coalesce(z_score > 2.5, false) AS spike FROM z),
m AS (SELECT u.*, f.spike FROM ({union}) u JOIN f USING (year, month)
  WHERE n > 0 QUALIFY sum(n) OVER (PARTITION BY value_column) >= 4)"""


def _monthly_sql(table_name, date, values):
    return f"""WITH {_months(table_name, date, values)}
SELECT '{date}' AS date_column, value_column, CAST(year AS INTEGER) AS year,
  CAST(month AS INTEGER) AS month, strftime(make_date(year, month, 1), '%b') AS month_name,
  printf('%d-%02d', year, month) AS year_month,
  strftime(make_date(year, month, 1), '%b %Y') AS label, round(s, 2) AS total,
  round(s / n, 2) AS avg, n AS count, spike AS is_volume_anomaly FROM m"""


def _volume_sql(table_name, date):
    return f"""WITH {_months(table_name, date, ["1"])}
SELECT '{date}' AS date_column, printf('%d-%02d', year, month) AS period, row_count,
  round(z_score, 2) AS z_score, round(others, 1) AS avg_other_periods FROM f WHERE spike"""


def _changes_sql(table_name, date, values):
    return f"""WITH {_months(table_name, date, values)},
k AS (SELECT * FROM m WHERE NOT spike),
y AS (SELECT value_column, year, sum(s) AS s, sum(n) AS n FROM k GROUP BY 1, 2),
r AS (SELECT *, CAST(greatest(10, ceil(sum(n) OVER (PARTITION BY value_column) * 0.05::DOUBLE))
  AS INTEGER) AS need FROM y),
v AS (SELECT value_column, any_value(need) AS need, count(*) FILTER (WHERE n >= need) AS n_valid,
    min(year) FILTER (WHERE n >= need) AS first_year, max(year) FILTER (WHERE n >= need) AS last_year,
    arg_min(s, year) FILTER (WHERE n >= need) AS first_sum,
    arg_max(s, year) FILTER (WHERE n >= need) AS last_sum,
    coalesce(string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) FILTER (WHERE n < need), '') AS excluded,
    string_agg(year || ' (' || n || ')', ', ' ORDER BY year) FILTER (WHERE n < need) AS only_had
  FROM r GROUP BY 1),
l AS (SELECT value_column, string_agg(DISTINCT CAST(year AS VARCHAR), ', ') AS lost FROM m a
  WHERE spike AND NOT EXISTS (SELECT 1 FROM y WHERE y.value_column = a.value_column
  AND y.year = a.year) GROUP BY 1),
t AS (SELECT k.value_column, s, row_number() OVER (PARTITION BY k.value_column ORDER BY month DESC)
  AS rn FROM k JOIN v ON k.value_column = v.value_column AND k.year = v.last_year),
p AS (SELECT v.*, coalesce(l.lost, '') AS lost, CASE WHEN n_valid >= 2 THEN round((last_sum - first_sum)
    / nullif(abs(first_sum), 0) * 100, 1) END AS yoy,
    round((t1.s - t2.s) / nullif(abs(t2.s), 0) * 100, 1) AS mom
  FROM v LEFT JOIN l USING (value_column) LEFT JOIN t t1 ON t1.value_column = v.value_column AND t1.rn = 1
  LEFT JOIN t t2 ON t2.value_column = v.value_column AND t2.rn = 2),
w AS (SELECT *, array_to_string(list_transform(string_split(value_column, '_'),
  lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title FROM p)
SELECT value_column AS metric_column, '{date}' AS date_column, yoy AS yoy_pct_change,
  yoy AS first_last_year_pct, mom AS mom_pct_change, n_valid, CAST(first_year AS INTEGER) AS first_year,
  CAST(last_year AS INTEGER) AS last_year, excluded AS excluded_years,
  lost AS years_lost_to_volume_anomaly, need AS min_sample_size_required,
  concat_ws(' ', CASE WHEN yoy IS NOT NULL THEN printf('%s: %s %.1f%% between %d (%s) and %d (%s); '
    || 'years with under %d rows and spike months are left out.', title,
    CASE WHEN yoy > 0 THEN 'up' WHEN yoy < 0 THEN 'down' ELSE 'unchanged,' END, abs(yoy), first_year,
    format('{{:,.2f}}', first_sum), last_year, format('{{:,.2f}}', last_sum), need)
   WHEN n_valid < 2 AND (excluded <> '' OR lost <> '') THEN title || ': years not compared: '
    || concat_ws('; ', 'too few rows in ' || only_had, CASE WHEN lost <> '' THEN 'only spike months in ' || lost END) || '.' END,
   CASE WHEN mom IS NOT NULL THEN printf('Last month of %d against the one before: %s %.1f%%.', last_year,
    CASE WHEN mom > 0 THEN 'up' WHEN mom < 0 THEN 'down' ELSE 'unchanged,' END, abs(mom)) END)
 AS summary
FROM w WHERE yoy IS NOT NULL OR mom IS NOT NULL OR excluded <> '' OR lost <> ''"""


def _best_worst_sql(table_name, date, values):
    return f"""WITH {_months(table_name, date, values)}
SELECT value_column, count(*) AS reliable_periods,
  arg_max(printf('%d-%02d', year, month), s) AS best_period,
  round(max(s), 2) AS best_total, arg_min(printf('%d-%02d', year, month), s) AS worst_period,
  round(min(s), 2) AS worst_total
FROM m WHERE NOT spike AND n >= 10 GROUP BY 1"""


def _trends_sql(table_name, date, values, key):
    union = "\nUNION ALL ".join(
        f"SELECT '{v}' AS value_column, CAST({v} AS DOUBLE) AS y, row_number() OVER (ORDER BY "
        f"{date}, {key}) - 1 AS x, count(*) OVER () AS n FROM {table_name} WHERE {date} IS NOT NULL "
        f"AND {v} IS NOT NULL" for v in values)
    return f"""WITH r AS ({union}),
e AS (SELECT *, greatest(least(greatest(3, ceil(n * 0.05::DOUBLE)), n // 2), 1) AS w FROM r),
f AS (SELECT value_column, any_value(n) AS n, any_value(w) AS w, stddev_pop(y) AS sd,
  regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, avg(y) FILTER (WHERE x < w) AS start,
  avg(y) FILTER (WHERE x >= n - w) AS fin FROM e GROUP BY 1),
g AS (SELECT *, CASE WHEN w >= 3 THEN (fin - start) / nullif(abs(start), 0) * 100 END AS change,
  CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS sd_dir
  FROM f WHERE n >= 5 AND sd > 0),
h AS (SELECT *, CASE WHEN change IS NULL THEN sd_dir WHEN change > 0 THEN 'increasing'
  WHEN change < 0 THEN 'decreasing' ELSE 'flat' END AS dir FROM g)
SELECT '{date}' AS date_column, value_column, dir AS direction, sd_dir AS slope_direction,
  change IS NOT NULL AND sd_dir <> dir AND sd_dir <> 'flat' AND dir <> 'flat' AS direction_conflict,
  CASE WHEN r2 >= 0.5 THEN 'strong' WHEN r2 >= 0.2 THEN 'moderate' ELSE 'weak' END AS strength,
  round(r2, 3) AS r_squared, round(change, 1) AS pct_change_start_to_end,
  round(start, 2) AS start_value, round(fin, 2) AS end_value, CAST(w AS BIGINT) AS start_sample_size,
  CAST(w AS BIGINT) AS end_sample_size, w < 3 AS insufficient_edge_data, n AS total_sample_size
FROM h"""


def _forecast_sql(table_name, date, values, min_r2):
    union = "\nUNION ALL ".join(
        f"SELECT '{v}' AS value_column, {date} AS moment, avg({v}) AS y FROM {table_name} "
        f"WHERE {date} IS NOT NULL AND {v} IS NOT NULL GROUP BY 2" for v in values)
    return f"""WITH s AS ({union}),
r AS (SELECT *, row_number() OVER p - 1 AS x, epoch_us(moment) - lag(epoch_us(moment)) OVER p AS gap
  FROM s WINDOW p AS (PARTITION BY value_column ORDER BY moment)),
f AS (SELECT value_column, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
  regr_r2(y, x) AS r2, stddev_pop(y) AS sd, max(moment) AS last_at, arg_max(y, x) AS last_y,
  CAST(round(quantile_cont(gap, 0.5)) AS BIGINT) AS step FROM r GROUP BY 1
  HAVING count(*) >= 8 AND stddev_pop(y) > 0 AND regr_r2(y, x) >= {min_r2})"""


def _frame_sql(table_name, date, value, min_r2):
    return _forecast_sql(table_name, date, [value], min_r2) + """
SELECT moment, round(y, 6) AS value, round(y, 6) AS lower_bound, round(y, 6) AS upper_bound,
  'historical' AS type FROM r WHERE value_column IN (SELECT value_column FROM f)
UNION ALL
SELECT make_timestamp(epoch_us(last_at) + step * (i + 1)), round(a + b * (n + i), 6),
  round(a + b * (n + i) - 1.96 * sd * sqrt(greatest(1 - r2, 0)), 6),
  round(a + b * (n + i) + 1.96 * sd * sqrt(greatest(1 - r2, 0)), 6), 'forecast'
FROM f, range(5) t(i)"""


def _summary_sql(table_name, date, values, min_r2):
    return _forecast_sql(table_name, date, values, min_r2) + f"""
SELECT '{date}' AS date_column, value_column, round(r2, 3) AS r_squared,
  round(b, 4) AS slope_per_period, 5 AS periods_ahead, round(a + b * (n + 4), 2)
  AS projected_end_value, round((a + b * (n + 4) - last_y) / nullif(abs(last_y), 0) * 100, 1)
  AS pct_projected_change FROM f"""


def _level(spark, folder):
    """A series that does rise, with noise around its line."""
    return table(spark, folder, "events").selectExpr("ts", "event_id + value * 10 AS level")


EVENT_NUMBERS = ["event_id", "user_id", "value"]

def _spiked(s, d):
    """Orders of January 1996 forty times, and of 1999 only one month, a hundred times."""
    o = table(s, d, "orders").select("o_orderdate", "o_totalprice").where("year(o_orderdate) <> 1999 OR month(o_orderdate) = 5")
    times = F.when((F.year("o_orderdate") == 1996) & (F.month("o_orderdate") == 1), 40).when(F.year("o_orderdate") == 1999, 100).otherwise(1)
    return o.select("o_orderdate", "o_totalprice", F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


SPIKED = """(SELECT o_orderdate, o_totalprice FROM orders, LATERAL (SELECT unnest(range(0,
  CASE WHEN year(o_orderdate) = 1996 AND month(o_orderdate) = 1 THEN 40 WHEN year(o_orderdate) = 1999 THEN 100 ELSE 1 END)))
  WHERE year(o_orderdate) <> 1999 OR month(o_orderdate) = 5)"""

QUERIES = {
    "volume_anomalies_spiked": (lambda s, d: periods.volume_anomalies(_spiked(s, d), "o_orderdate"), _volume_sql(SPIKED, "o_orderdate")),
    "yoy_mom_lost_year": (lambda s, d: periods.period_changes(_spiked(s, d), "o_orderdate", ["o_totalprice"]),
                          _changes_sql(SPIKED, "o_orderdate", ["o_totalprice"])),
    "monthly_totals": (
        lambda s, d: periods.monthly_totals(table(s, d, "lineitem"), "l_shipdate", LINE_NUMBERS),
        _monthly_sql("lineitem", "l_shipdate", LINE_NUMBERS)),
    "volume_anomalies": (
        lambda s, d: periods.volume_anomalies(table(s, d, "lineitem"), "l_shipdate"),
        _volume_sql("lineitem", "l_shipdate")),
    "yoy_mom": (
        lambda s, d: periods.period_changes(table(s, d, "orders"), "o_orderdate"),
        _changes_sql("orders", "o_orderdate", ORDER_NUMBERS)),
    "yoy_mom_single_year": (
        lambda s, d: periods.period_changes(table(s, d, "events"), "ts"),
        _changes_sql("events", "ts", EVENT_NUMBERS)),
    "best_worst_period": (
        lambda s, d: periods.best_worst_period(table(s, d, "orders"), "o_orderdate"),
        _best_worst_sql("orders", "o_orderdate", ORDER_NUMBERS)),
    "trend_fit": (
        lambda s, d: trends.trends(table(s, d, "orders"), ["o_orderkey"]),
        _trends_sql("orders", "o_orderdate", ORDER_NUMBERS, "o_orderkey")),
    "trend_fit_events": (
        lambda s, d: trends.trends(table(s, d, "events"), ["event_id"]),
        _trends_sql("events", "ts", EVENT_NUMBERS, "event_id")),
    "best_trend": (
        lambda s, d: trends.best_trend(trends.trends(table(s, d, "orders"), ["o_orderkey"])),
        _trends_sql("orders", "o_orderdate", ORDER_NUMBERS, "o_orderkey")
        + " ORDER BY w < 3, round(r2, 3) DESC, value_column LIMIT 1"),
    "forecast": (
        lambda s, d: trends.forecast(_level(s, d), "ts", "level"),
        _frame_sql("(SELECT ts, event_id + value * 10 AS level FROM events) e", "ts", "level",
                   0.1)),
    "forecast_orders": (
        lambda s, d: trends.forecast(table(s, d, "orders"), "o_orderdate", "o_totalprice",
                                     min_r_squared=0.0),
        _frame_sql("orders", "o_orderdate", "o_totalprice", 0.0)),
    "forecast_gated": (
        lambda s, d: trends.forecast_summary(table(s, d, "events")),
        _summary_sql("events", "ts", EVENT_NUMBERS, 0.1)),
    "best_forecast": (
        lambda s, d: trends.best_forecast(table(s, d, "orders"), min_r_squared=0.0),
        _summary_sql("orders", "o_orderdate", ORDER_NUMBERS, 0.0)
        + " ORDER BY round(r2, 3) DESC, value_column LIMIT 1"),
}
