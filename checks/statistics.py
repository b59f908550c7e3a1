"""Profiles and statistics."""

from tablewright.operators import profile, statistics

from .tables import DIRTY_ORDERS, dirty_orders, table

SKEWNESS = "skewness({c})"


def _missing_sql(source: str, columns: list[str]) -> str:
    one = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in columns)
    total = " + ".join(columns)
    rows = "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS BIGINT) AS missing, "
        f"round({c} * 100.0::DOUBLE / n, 1) AS missing_pct, CAST({total} AS BIGINT) AS total_missing "
        "FROM m" for c in columns)
    return f"WITH src AS ({source}), m AS (SELECT count(*) AS n, {one} FROM src)\n{rows}"


DIRTY_COLUMNS = ["order_id", "customer_ref", "total_amount", "order_date", "order_status",
                 "is_gift", "order_rating", "account_ref", "delivery_time_mins"]
LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


def _each(columns, template, joiner="\nUNION ALL "):
    return joiner.join(template.replace("{c}", c) for c in columns)


NUMERIC_SUMMARY = _each(LINEITEM_NUMBERS, """SELECT '{c}' AS "column", round(avg({c}), 2) AS mean,
  round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min,
  round(CAST(median({c}) AS DOUBLE), 2) AS median, round(CAST(max({c}) AS DOUBLE), 2) AS max
FROM lineitem""")

_PROFILE = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
            "c_acctbal": "double", "c_mktsegment": "string"}
COLUMN_PROFILE = "\nUNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS dtype,
  (SELECT count(DISTINCT {c}) FROM customer) AS n_unique,
  (SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 1) FROM customer)
    AS missing_pct,
  (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v
    FROM customer WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS sample_values"""
                                     for c, t in _PROFILE.items())

def kpis_sql(table_name, columns):
    return f"""WITH k AS ({_each(columns, '''SELECT '{c}' AS "column", avg({c}) AS mean,
  median({c}) AS median, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
  sum(CAST({c} AS DOUBLE)) AS sum, count({c}) AS count,
  lower('{c}') LIKE '%key%' AND count(DISTINCT {c}) = count({c}) AS is_key FROM ''' + table_name)})
SELECT "column", round(mean, 2) AS mean, round(CAST(median AS DOUBLE), 2) AS median,
  round(std, 2) AS std, round(CAST(min AS DOUBLE), 2) AS min, round(CAST(max AS DOUBLE), 2) AS max,
  round(sum, 2) AS sum, count, round(std / nullif(mean, 0), 3) AS coefficient_of_variation
FROM k WHERE min < max AND NOT is_key ORDER BY std DESC, "column" LIMIT 6"""


def _pairs_sql(table_name, columns, threshold):
    union = "\nUNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM {table_name}"
        for i, a in enumerate(columns) for b in columns[i + 1:])
    return f"""SELECT column_a, column_b, round(r, 3) AS correlation,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({union}) WHERE NOT isnan(r) AND abs(r) >= {threshold}"""


def _anomalies_sql(table_name, columns):
    union = "\nUNION ALL ".join(f"""SELECT '{c}' AS "column",
    count(*) FILTER (WHERE abs(({c} - s.m) / s.sd) > 3) AS z_score_outliers,
    CASE WHEN s.q3 > s.q1 THEN count(*) FILTER (WHERE {c} < s.q1 - 1.5 * (s.q3 - s.q1)
      OR {c} > s.q3 + 1.5 * (s.q3 - s.q1)) ELSE 0 END AS iqr_outliers, s.sk AS skew
  FROM {table_name}, (SELECT avg({c}) AS m, stddev_samp({c}) AS sd,
    quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, skewness({c}) AS sk,
    count({c}) AS n FROM {table_name}) s
  WHERE s.n >= 10 AND s.sd > 0 GROUP BY s.m, s.sd, s.q1, s.q3, s.sk""" for c in columns)
    return f"""SELECT "column", z_score_outliers, iqr_outliers, round(skew, 2) AS skew,
  CASE WHEN skew > 1.5 THEN 'right (high-value outliers)'
       WHEN skew < -1.5 THEN 'left (low-value outliers)' ELSE 'normal' END AS skew_direction
FROM ({union}) WHERE z_score_outliers > 0 OR iqr_outliers > 0 OR abs(skew) > 1.5"""


def _category_sql(table_name, columns, top_n):
    union = "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count FROM {table_name} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns)
    return f"""SELECT "column", unique_values, CAST(rank AS INTEGER) AS rank, value, count,
  round(count * 100.0::DOUBLE / (SELECT count(*) FROM {table_name}), 1) AS pct
FROM (SELECT *, count(*) OVER (PARTITION BY "column") AS unique_values,
        row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank
      FROM ({union})) WHERE rank <= {top_n}"""


PART_TEXT = ["p_name", "p_brand", "p_type"]
STATUS_SQL = """WITH g AS (SELECT o_orderstatus AS status, sum(o_totalprice) AS revenue,
  count(*) AS count FROM orders GROUP BY 1), f AS (SELECT *, {completed} AS is_completed FROM g{join})
SELECT status, round(revenue, 2) AS revenue, count,
  round(revenue * 100 / sum(revenue) OVER (), 1) AS pct_of_total_revenue, is_completed,
  round(sum(revenue) OVER (), 2) AS total_revenue,
  round(coalesce(sum(revenue) FILTER (WHERE is_completed) OVER (), 0), 2) AS reliable_revenue,
  round(sum(revenue) OVER () - coalesce(sum(revenue) FILTER (WHERE is_completed) OVER (), 0), 2)
    AS excluded_revenue FROM f"""
KEYWORDS = "cancel|fail|refund|pending|reject|void|return|chargeback|declin|abandon"

QUALITY_SQL = """WITH s AS (SELECT avg(o_orderkey) AS m1, stddev_samp(o_orderkey) AS s1,
    avg(o_custkey) AS m2, stddev_samp(o_custkey) AS s2, avg(o_totalprice) AS m3,
    stddev_samp(o_totalprice) AS s3 FROM orders),
r AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey IS NULL)
      + count(*) FILTER (WHERE o_custkey IS NULL) + count(*) FILTER (WHERE o_orderstatus IS NULL)
      + count(*) FILTER (WHERE o_totalprice IS NULL) + count(*) FILTER (WHERE o_orderdate IS NULL)
      + count(*) FILTER (WHERE o_orderpriority IS NULL) AS missing,
    1 - (avg((abs((o_orderkey - m1) / s1) > 3)::INT) + avg((abs((o_custkey - m2) / s2) > 3)::INT)
       + avg((abs((o_totalprice - m3) / s3) > 3)::INT)) / 3 AS validity FROM orders, s),
d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS dup FROM orders),
p AS (SELECT missing, dup, validity, 1 - missing / (n * 6.0::DOUBLE) AS completeness,
    1 - dup / n::DOUBLE AS uniqueness FROM r, d),
o AS (SELECT *, round((completeness * 0.4::DOUBLE + uniqueness * 0.3::DOUBLE
    + validity * 0.3::DOUBLE) * 100, 1) AS overall_score FROM p)
SELECT overall_score, CASE WHEN overall_score >= 95 THEN 'A+' WHEN overall_score >= 90 THEN 'A'
    WHEN overall_score >= 85 THEN 'B+' WHEN overall_score >= 80 THEN 'B'
    WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade,
  round(completeness * 100, 1) AS completeness_pct, round(uniqueness * 100, 1) AS uniqueness_pct,
  round(validity * 100, 1) AS validity_pct, CAST(missing AS BIGINT) AS missing_cells,
  CAST(dup AS BIGINT) AS duplicate_rows FROM o"""


def _classified(spark, folder):
    orders = table(spark, folder, "orders")
    # the supplied lookup: open orders are not completed; statuses it lacks count as completed
    lookup = spark.createDataFrame([("F", True), ("O", False)],
                                   "status string, is_completed boolean")
    return statistics.revenue_by_status(orders, classification=lookup)


def _class_rows(spark, folder):
    lookup = spark.createDataFrame([("F", True), ("O", False)],
                                   "status string, is_completed boolean")
    return statistics.classify_statuses(table(spark, folder, "orders"), lookup)


#: A few prices a hundred times too high, a fee that follows the price, a discount that falls with it.
PLANTED = """SELECT o_custkey, CASE WHEN o_orderkey % 500 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 500 = 0 THEN o_totalprice * 3 ELSE o_totalprice * CAST(0.02 AS DOUBLE) END AS fee,
  CASE WHEN o_orderkey % 500 = 0 THEN -o_totalprice ELSE -o_totalprice * CAST(0.001 AS DOUBLE) END AS discount FROM orders"""

QUERIES = {
    "revenue_by_status": (
        lambda s, d: statistics.revenue_by_status(table(s, d, "orders")),
        STATUS_SQL.format(completed=f"NOT regexp_matches(lower(status), '{KEYWORDS}')", join="")),
    "revenue_by_status_classified": (
        _classified, STATUS_SQL.format(completed="status <> 'O'", join="")),
    "status_classification": (
        _class_rows,
        "SELECT DISTINCT o_orderstatus AS status, o_orderstatus <> 'O' AS is_completed FROM orders"),
    "missing_profile": (
        lambda s, d: profile.missing_profile(dirty_orders(s, d)),
        _missing_sql(DIRTY_ORDERS, DIRTY_COLUMNS)),
    "raw_missing": (
        lambda s, d: profile.raw_missing(dirty_orders(s, d)),
        f"""WITH src AS ({DIRTY_ORDERS}), c AS (SELECT count(*) AS n, {_each(
            DIRTY_COLUMNS, "count(*) FILTER (WHERE {c} IS NULL)", " + ")} AS nulls, {_each(
            ["total_amount", "order_date", "order_status", "is_gift", "account_ref"],
            "count(*) FILTER (WHERE {c} IN ('None','none','NULL','null','nan','NaN','NA','N/A'))",
            " + ")} AS texts FROM src)
        SELECT n AS n_rows, CAST(nulls AS BIGINT) AS null_cells, CAST(texts AS BIGINT) AS
        null_text_cells, CAST(nulls + texts AS BIGINT) AS missing_cells FROM c"""),
    "numeric_summary": (
        lambda s, d: profile.numeric_summary(table(s, d, "lineitem")), NUMERIC_SUMMARY),
    "column_profile": (
        lambda s, d: profile.column_profile(table(s, d, "customer")), COLUMN_PROFILE),
    "column_roles": (
        lambda s, d: profile.column_roles(table(s, d, "events")),
        """SELECT * FROM (VALUES ('event_id', 'id'), ('ts', 'datetime'), ('user_id', 'id'),
        ('value', 'numeric')) t("column", role)
        UNION ALL SELECT 'event_type', CASE WHEN count(DISTINCT event_type) <= 60
          THEN 'categorical' ELSE 'text' END FROM events
        UNION ALL SELECT 'props', CASE WHEN count(DISTINCT props) <= 60
          THEN 'categorical' ELSE 'text' END FROM events"""),
    "domain_evidence": (
        lambda s, d: profile.domain_evidence(table(s, d, "lineitem")),
        _each(LINEITEM_NUMBERS, """SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min,
        CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 2) AS mean, count(*) AS row_count,
        CAST(11 AS BIGINT) AS column_count FROM lineitem""")),
    "kpis": (lambda s, d: statistics.kpis(table(s, d, "lineitem")), kpis_sql("lineitem", LINEITEM_NUMBERS)),
    "correlations": (
        lambda s, d: statistics.correlations(table(s, d, "lineitem"), 0.0),
        _pairs_sql("lineitem", LINEITEM_NUMBERS, 0.0)),
    "correlations_strong": (
        lambda s, d: statistics.correlations(table(s, d, "lineitem")),
        _pairs_sql("lineitem", LINEITEM_NUMBERS, 0.6)),
    "anomalies": (
        lambda s, d: statistics.anomalies(table(s, d, "lineitem")),
        _anomalies_sql("lineitem", LINEITEM_NUMBERS)),
    "correlations_planted": (
        lambda s, d: statistics.correlations(s.sql(PLANTED.replace("FROM orders", f"FROM parquet.`{d}/orders.parquet`"))),
        _pairs_sql(f"({PLANTED})", ["o_custkey", "price", "fee", "discount"], 0.6)),
    "anomalies_planted": (
        lambda s, d: statistics.anomalies(s.sql(PLANTED.replace("FROM orders", f"FROM parquet.`{d}/orders.parquet`"))),
        _anomalies_sql(f"({PLANTED})", ["o_custkey", "price", "fee", "discount"])),
    "anomalies_events": (
        lambda s, d: statistics.anomalies(table(s, d, "events")),
        _anomalies_sql("events", ["event_id", "user_id", "value"])),
    "category_summary": (
        lambda s, d: statistics.category_summary(table(s, d, "part")),
        _category_sql("part", PART_TEXT, 5)),
    "chart_eligible_columns": (
        lambda s, d: statistics.chart_columns(table(s, d, "part")),
        f"""SELECT "column", unique_values, pct AS top_pct,
        unique_values <= 12 AND pct >= 5 AS eligible
        FROM ({_category_sql("part", PART_TEXT, 1)})"""),
    "quality_score": (lambda s, d: statistics.quality_score(table(s, d, "orders")), QUALITY_SQL),
}
