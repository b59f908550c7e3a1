"""Cleaning operators on the dirty views."""

from pyspark.sql import functions as F

from tablewright.functions import cells, dates, vocab
from tablewright.operators import cleaning, dedup, impute, profile, similarity

from .tables import DIRTY_EVENTS, DIRTY_ORDERS, dirty_events, dirty_orders, table

MARKERS = ", ".join("'" + m + "'" for m in vocab.NULL_MARKERS)
ORDER_TEXT = ["total_amount", "order_date", "order_status", "is_gift", "account_ref"]


def swept(c):
    return f"CASE WHEN lower(trim({c})) NOT IN ({MARKERS}) THEN {c} END"


def number(c):
    bare = (f"regexp_replace(regexp_replace(regexp_replace(trim({swept(c)}), '^\\((.*)\\)$', "
            f"'-\\1'), '[₹$€£¥₩,%\\s]', '', 'g'), '^\\+', '')")
    plain = "'^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?$'"
    return (f"CASE WHEN regexp_matches({bare}, '^-?[0-9]+\\.?[0-9]*[kKmMbB]$') THEN "
            f"CAST({bare}[:-2] AS DOUBLE) * CASE lower({bare}[-1]) WHEN 'k' THEN 1e3 WHEN 'm' "
            f"THEN 1e6 ELSE 1e9 END WHEN regexp_matches({bare}, {plain}) "
            f"THEN CAST({bare} AS DOUBLE) END")


def cleaned(c):
    return (f"nullif(trim(regexp_replace(regexp_replace({c}, '[:.,\\-_!;\"''?/*#@|\\\\+=(){{}}"
            f"\\[\\]<>^~`%]', ' ', 'g'), '\\s+', ' ', 'g')), '')")


def title(c):
    return (f"array_to_string(list_transform(string_split({c}, ' '), lambda x: "
            f"upper(x[1]) || lower(x[2:])), ' ')")


def yes_no(c):
    true = ", ".join(f"'{w}'" for w in vocab.TRUE_WORDS)
    false = ", ".join(f"'{w}'" for w in vocab.FALSE_WORDS)
    return (f"CASE WHEN lower(trim({c})) IN ({true}) THEN 'Yes' WHEN lower(trim({c})) IN ({false}) "
            f"THEN 'No' ELSE {c} END")


def parsed_date(c):
    return f"CAST(try_strptime({c}, '%d-%m-%Y') AS DATE)"


def _swept_orders(s, d):
    return cleaning.sweep_nulls(dirty_orders(s, d))


def _lookup(spark):
    return spark.createDataFrame(
        [("order_status", "Canceled", "Cancelled"), ("order_status", " PENDING!", "Pending"),
         ("order_status", "delivered", "Delivered"), ("is_gift", "TRUE", "yes")],
        "column string, dirty string, canonical string")


def _format_scores(s, d):
    fit = dates.fit_dates(dirty_orders(s, d), ["order_date"])["order_date"]
    rows = [(f, round(share, 4), fit.day_first, f in (fit.formats() or ()))
            for f, share in fit.format_shares.items()]
    return s.createDataFrame(rows, "format string, share double, day_first boolean, chosen boolean")


_STRPTIME = {"d-M-yyyy": "%d-%m-%Y", "M-d-yyyy": "%m-%d-%Y"}
FORMAT_SQL = f"""WITH o AS ({DIRTY_ORDERS}), h AS (SELECT
  count(order_date) AS n, count(try_strptime(order_date, '%d-%m-%Y')) AS dmy,
  count(try_strptime(order_date, '%m-%d-%Y')) AS mdy,
  count(*) FILTER (WHERE CAST(order_date[1:2] AS INT) > 12) >
  count(*) FILTER (WHERE CAST(order_date[4:5] AS INT) > 12) AS day_first FROM o)
SELECT format, round(CASE format WHEN 'd-M-yyyy' THEN dmy WHEN 'M-d-yyyy' THEN mdy ELSE 0 END
  / n::DOUBLE, 4) AS share, day_first, format = 'd-M-yyyy' AS chosen
FROM h, (VALUES {", ".join(f"('{f}')" for f in dict.fromkeys(
    dates.ladder(True) + dates.ladder(False)))}) t(format)"""

# Month spellings of every order date, cycling through the accepted forms.
MONTH_TEXT = """SELECT o_orderkey AS order_id, CASE o_orderkey % 4
  WHEN 0 THEN {month_name} || '-' || {year} WHEN 1 THEN {year} || ' ' || {month_name}
  WHEN 2 THEN {month} || '/' || {year} ELSE {month_name} || ' ' || substr({year}, 3, 2) END
  AS period FROM orders"""


def _month_years(s, d):
    orders = table(s, d, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    year, name = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MMM")
    number_text = F.date_format("o_orderdate", "MM")
    form = F.col("o_orderkey") % 4
    text = (F.when(form == 0, F.concat_ws("-", name, year))
            .when(form == 1, F.concat_ws(" ", year, name))
            .when(form == 2, F.concat_ws("/", number_text, year))
            .otherwise(F.concat_ws(" ", name, F.substring(year, 3, 2))))
    return orders.select("o_orderkey", dates.parse_month_year(text).alias("month_start"))


def _unix(s, d):
    text = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    return table(s, d, "orders").select(
        "o_orderkey", dates.parse_date(text, ("unix",)).alias("order_date"))


def _signature_ids(s, d):
    frame = dirty_orders(s, d).select("order_id", "account_ref")
    return cleaning.null_corrupted_ids(frame)


def _deduped(s, d):
    return dedup.deduplicate(dirty_events(s, d), ["value"])


def _untrusted(s, d):
    return dedup.id_gate(table(s, d, "lineitem").withColumnRenamed("l_orderkey", "id"), "id")


DEDUP_SQL = f"""SELECT DISTINCT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY value, user_id, event_type) AS rn
  FROM ({DIRTY_EVENTS})) WHERE rn = 1 OR event_id IS NULL"""

NUMBERS_PROFILE = "\nUNION ALL ".join(f"""SELECT '{c}' AS "column", count({swept(c)}) AS n_values,
  count({number(c)}) AS n_numbers, round(count({number(c)})::DOUBLE / count({swept(c)}), 4)
  AS numeric_share, count(*) FILTER (WHERE regexp_matches({c}, '[₹$€£¥₩]')) AS n_currency,
  coalesce(bool_and({number(c)} % 1 = 0), true) AS whole,
  count({number(c)})::DOUBLE / count({swept(c)}) > 0.5 AS to_number FROM ({DIRTY_ORDERS})"""
                                      for c in ORDER_TEXT)

IQR_SQL = """WITH q AS (SELECT {quartiles} FROM lineitem)
SELECT {columns} FROM lineitem, q"""


def _iqr_sql():
    from .statistics import LINEITEM_NUMBERS
    quartiles = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3, "
                          f"count(DISTINCT {c}) AS {c}_n" for c in LINEITEM_NUMBERS)
    kept = []
    for c in LINEITEM_NUMBERS:
        low = f"({c}_1 - 3 * ({c}_3 - {c}_1))"
        if c in ("l_quantity", "l_tax", "l_discount"):
            low = f"greatest({low}, 0)"
        high = f"({c}_3 + 3 * ({c}_3 - {c}_1))"
        kept.append(f"round(CAST(CASE WHEN {c}_n <= 5 OR {c}_3 = {c}_1 THEN {c} ELSE "
                    f"least(greatest({c}, {low}), {high}) END AS DOUBLE), 4) AS {c}")
    return IQR_SQL.format(quartiles=quartiles, columns=", ".join(kept))


def _capped(s, d):
    from .statistics import LINEITEM_NUMBERS
    frame = cleaning.cap_outliers(table(s, d, "lineitem").select(*LINEITEM_NUMBERS))
    return frame.select(*[F.round(F.col(c).cast("double"), 4).alias(c) for c in LINEITEM_NUMBERS])


def _squeezed(s, d):
    """Order prices on a far wider scale, so the cap has something to cap."""
    frame = table(s, d, "orders").selectExpr("o_orderkey", "pow(o_totalprice / 1000, 3) AS spread")
    return cleaning.cap_outliers(frame).select("o_orderkey", F.round("spread", 2).alias("spread"))


SIDE = """SELECT '{side}' AS side, round(100 - nulls * 100.0::DOUBLE / (n * {width}), 1)
  AS completeness_pct, round(100 - dup * 100.0::DOUBLE / n, 1) AS uniqueness_pct,
  round(100 - bad * 100.0::DOUBLE / texts, 1) AS validity_pct,
  round(formed * 100.0::DOUBLE / cats, 1) AS consistency_pct FROM (
  SELECT count(*) AS n, {nulls} AS nulls, {texts} AS texts, {bad} AS bad,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({source}))) AS dup,
    {cats} AS cats, {formed} AS formed FROM ({source}))"""


def _side_sql(side, source, columns, text):
    def total(template):
        return " + ".join(template.format(c=c) for c in text)
    formed = (f"CASE WHEN count(DISTINCT {{c}}) <= 60 AND coalesce(avg(({{c}} = {title('{c}')} AND "
              f"{{c}} = trim({{c}}) AND NOT regexp_matches({{c}}, '\\s{{{{2,}}}}'))::INT), 1) >= 0.9 "
              f"THEN 1 ELSE 0 END")
    return SIDE.format(
        side=side, source=source, width=len(columns),
        nulls=" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns),
        texts=total("count({c})"),
        bad=total("count(*) FILTER (WHERE lower(trim({c})) IN (" + MARKERS + "))"),
        cats=total("CASE WHEN count(DISTINCT {c}) <= 60 THEN 1 ELSE 0 END"),
        formed=total(formed))


CARD_COLUMNS = ["order_id", "total_amount", "order_status", "is_gift"]
CARD_TEXT = CARD_COLUMNS[1:]
CARD_RAW = f"SELECT {', '.join(CARD_COLUMNS)} FROM ({DIRTY_ORDERS})"
CARD_CLEAN = f"""SELECT order_id, {number('total_amount')} AS total_amount,
  {title(cleaned(swept('order_status')))} AS order_status, {yes_no(swept('is_gift'))} AS is_gift
  FROM ({CARD_RAW})"""
SCORECARD_SQL = f"""WITH b AS ({_side_sql('before', CARD_RAW, CARD_COLUMNS, CARD_TEXT)}
UNION ALL {_side_sql('after', CARD_CLEAN, CARD_COLUMNS, CARD_TEXT[1:])}),
g AS (SELECT *, (completeness_pct + uniqueness_pct + validity_pct + consistency_pct) / 4 AS s FROM b)
SELECT side, completeness_pct, uniqueness_pct, validity_pct, consistency_pct,
  CASE WHEN s >= 95 THEN 'A' WHEN s >= 85 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 50 THEN 'D'
  ELSE 'F' END AS grade, round(s, 2) AS score,
  (SELECT round(max(round(s, 2)) FILTER (WHERE side = 'after')
     - max(round(s, 2)) FILTER (WHERE side = 'before'), 1) FROM g) AS delta_points FROM g"""


def _scorecard(s, d):
    raw = dirty_orders(s, d).select(*CARD_COLUMNS)
    swept_rows = cleaning.sweep_nulls(raw)
    clean = swept_rows.select(
        "order_id", cells.parse_number(F.col("total_amount")).alias("total_amount"),
        F.initcap(cells.clean_text(F.col("order_status"))).alias("order_status"),
        cells.yes_no(F.col("is_gift")).alias("is_gift"))
    return profile.scorecard(raw, clean)


MODES = "(SELECT order_status FROM o WHERE order_status IS NOT NULL GROUP BY 1 " \
        "ORDER BY count(*) DESC, order_status LIMIT 1)"

QUERIES = {
    "standardise_names": (
        lambda s, d: cleaning.standardise_columns(table(s, d, "nation").toDF(
            " Nation Key ", "Nation-Name!", "Region  KEY (id)")),
        """SELECT n_nationkey AS nation_key, n_name AS nationname, n_regionkey AS region_key_id
        FROM nation"""),
    "drop_columns": (
        lambda s, d: cleaning.drop_columns(table(s, d, "part"), ["p_size", "not_there"])[0],
        "SELECT p_partkey, p_name, p_brand, p_type, p_retailprice FROM part"),
    "null_sweep": (
        _swept_orders,
        f"SELECT * REPLACE ({', '.join(f'{swept(c)} AS {c}' for c in ORDER_TEXT)}) "
        f"FROM ({DIRTY_ORDERS})"),
    "numeric_text_profile": (
        lambda s, d: cleaning.numeric_text_profile(dirty_orders(s, d)), NUMBERS_PROFILE),
    "parse_numeric": (
        lambda s, d: cleaning.convert_numbers(
            dirty_orders(s, d).select("order_id", "account_ref", "order_status")),
        f"""SELECT order_id, CAST({number('account_ref')} AS BIGINT) AS account_ref, order_status
        FROM ({DIRTY_ORDERS})"""),
    "currency_strip": (
        lambda s, d: cleaning.convert_numbers(dirty_orders(s, d).select("order_id", "total_amount")),
        f"SELECT order_id, {number('total_amount')} AS total_amount FROM ({DIRTY_ORDERS})"),
    "date_formats": (_format_scores, FORMAT_SQL),
    "parse_dates": (
        lambda s, d: cleaning.convert_dates(dirty_orders(s, d).select(
            "order_id", "order_date", "order_status")),
        f"""SELECT order_id, {parsed_date('order_date')} AS order_date, order_status
        FROM ({DIRTY_ORDERS})"""),
    "parse_month_year": (
        _month_years,
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders"),
    "parse_unix_seconds": (
        _unix,
        """SELECT o_orderkey, CASE WHEN epoch(o_orderdate) > 1e9 AND epoch(o_orderdate) < 2e10
        THEN CAST(o_orderdate AS DATE) END AS order_date FROM orders"""),
    "date_split": (
        lambda s, d: cleaning.split_dates(cleaning.convert_dates(
            table(s, d, "orders").select("o_orderkey", "o_orderdate"))),
        """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate,
        CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
        CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
        monthname(o_orderdate) AS o_orderdate_month_name FROM orders"""),
    "clean_text": (
        lambda s, d: cleaning.clean_text_columns(
            dirty_orders(s, d).select("order_id", "order_status", "total_amount", "order_date"),
            exclude=["order_date"]),
        f"""SELECT order_id, {cleaned('order_status')} AS order_status,
        {cleaned('total_amount')} AS total_amount, order_date FROM ({DIRTY_ORDERS})"""),
    "boolean_norm": (
        lambda s, d: cleaning.normalise_booleans(dirty_orders(s, d).select("order_id", "is_gift",
                                                                          "order_status")),
        f"SELECT order_id, {yes_no('is_gift')} AS is_gift, order_status FROM ({DIRTY_ORDERS})"),
    "title_case": (
        lambda s, d: dirty_orders(s, d).select("order_id", F.initcap(
            cells.clean_text(F.col("order_status"))).alias("order_status")),
        f"SELECT order_id, {title(cleaned('order_status'))} AS order_status FROM ({DIRTY_ORDERS})"),
    "canonical_map": (
        lambda s, d: cleaning.map_values(
            dirty_orders(s, d).select("order_id", "order_status", "is_gift"), _lookup(s)),
        f"""SELECT order_id, CASE order_status WHEN 'Canceled' THEN 'Cancelled' WHEN ' PENDING!'
        THEN 'Pending' WHEN 'delivered' THEN 'Delivered' ELSE order_status END AS order_status,
        CASE is_gift WHEN 'TRUE' THEN 'yes' ELSE is_gift END AS is_gift FROM ({DIRTY_ORDERS})"""),
    "corrupted_ids": (
        _signature_ids,
        f"""SELECT order_id, CASE WHEN NOT regexp_matches(account_ref, '[^0-9]') THEN account_ref
        END AS account_ref FROM ({DIRTY_ORDERS})"""),
    "format_values": (
        lambda s, d: table(s, d, "orders").select(
            "o_orderkey", cells.format_value(F.col("o_totalprice"), "$").alias("shown")),
        """SELECT o_orderkey, '$' || CASE WHEN abs(o_totalprice) >= 1e3
        THEN format('{:,.1f}', o_totalprice) ELSE format('{:,.2f}', o_totalprice) END
        AS shown FROM orders"""),
    "dedup_gate": (
        lambda s, d: dedup.id_gate(dirty_events(s, d), "event_id"),
        f"""WITH c AS (SELECT count(DISTINCT event_id) AS k, count(event_id) AS n FROM ({DIRTY_EVENTS}))
        SELECT 'event_id' AS id_column, k AS distinct_ids, n AS rows_with_id,
        round(k / n::DOUBLE, 4) AS uniqueness, round((n - k) / n::DOUBLE, 4) AS removal_share,
        k / n::DOUBLE >= 0.95 AND (n - k) / n::DOUBLE <= 0.3 AS trusted FROM c"""),
    "dedup_gate_untrusted": (
        _untrusted,
        """WITH c AS (SELECT count(DISTINCT l_orderkey) AS k, count(l_orderkey) AS n FROM lineitem)
        SELECT 'id' AS id_column, k AS distinct_ids, n AS rows_with_id,
        round(k / n::DOUBLE, 4) AS uniqueness, round((n - k) / n::DOUBLE, 4) AS removal_share,
        k / n::DOUBLE >= 0.95 AND (n - k) / n::DOUBLE <= 0.3 AS trusted FROM c"""),
    "dedup_gated": (_deduped, DEDUP_SQL),
    "dedup_full": (
        lambda s, d: dedup.drop_full_duplicates(dirty_events(s, d)),
        f"SELECT DISTINCT * FROM ({DIRTY_EVENTS})"),
    "duplicate_rows": (
        lambda s, d: dedup.duplicate_rows(dirty_events(s, d)),
        f"""SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({DIRTY_EVENTS})))
        AS duplicate_rows FROM ({DIRTY_EVENTS})"""),
    "retention": (
        lambda s, d: dedup.retention(dirty_events(s, d), _deduped(s, d)),
        f"""WITH a AS (SELECT count(*) AS n FROM ({DIRTY_EVENTS})),
        b AS (SELECT count(*) AS k FROM ({DEDUP_SQL}))
        SELECT n AS rows_before, k AS rows_after, n - k AS rows_removed,
        round(k * 100.0::DOUBLE / n, 1) AS retention_pct, k * 100.0 / n < 90 AS warning FROM a, b"""),
    "rating_scale": (
        lambda s, d: cleaning.rating_scales(dirty_orders(s, d)),
        f"""SELECT 'order_rating' AS "column", CASE WHEN min(order_rating) <= 0 THEN 0.0::DOUBLE
        ELSE 1.0::DOUBLE END AS scale_min, CASE WHEN max(order_rating) <= 5 THEN 5.0::DOUBLE
        WHEN max(order_rating) <= 10 THEN 10.0::DOUBLE WHEN max(order_rating) <= 50 THEN 50.0::DOUBLE
        WHEN max(order_rating) <= 100 THEN 100.0::DOUBLE ELSE round(max(order_rating) * 1.1, 1) END
        AS scale_max FROM ({DIRTY_ORDERS})"""),
    "domain_clip": (
        lambda s, d: cleaning.clip_domains(dirty_orders(s, d).select(
            "order_id", "order_rating", "delivery_time_mins")),
        f"""SELECT order_id, CASE WHEN order_rating IS NOT NULL THEN
        least(greatest(order_rating, 1), 10) END AS order_rating,
        greatest(delivery_time_mins, 0) AS delivery_time_mins FROM ({DIRTY_ORDERS})"""),
    "iqr_cap": (_capped, _iqr_sql()),
    "iqr_cap_wide": (
        _squeezed,
        """WITH o AS (SELECT o_orderkey, pow(o_totalprice / 1000, 3) AS spread FROM orders),
        q AS (SELECT quantile_cont(spread, 0.25) AS a, quantile_cont(spread, 0.75) AS b FROM o)
        SELECT o_orderkey, round(least(greatest(spread, a - 3 * (b - a)), b + 3 * (b - a)), 2)
        AS spread FROM o, q"""),
    "scorecard": (_scorecard, SCORECARD_SQL),
    "fill_simple": (
        lambda s, d: impute.fill_simple(cleaning.sweep_nulls(dirty_orders(s, d)).select(
            "order_id", "order_status", "order_rating")),
        f"""WITH o AS (SELECT order_id, {swept('order_status')} AS order_status, order_rating
          FROM ({DIRTY_ORDERS})) SELECT order_id, coalesce(order_status, {MODES}) AS order_status,
        coalesce(order_rating, (SELECT median(order_rating) FROM o)) AS order_rating FROM o"""),
    "ffill_bfill": (
        lambda s, d: impute.fill_dates(cleaning.convert_dates(dirty_orders(s, d).select(
            "order_id", "order_date")), ["order_id"]),
        f"""WITH o AS (SELECT order_id, {parsed_date('order_date')} AS order_date FROM ({DIRTY_ORDERS}))
        SELECT order_id, coalesce(last_value(order_date IGNORE NULLS) OVER (ORDER BY order_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(order_date IGNORE NULLS)
          OVER (ORDER BY order_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS order_date
        FROM o"""),
}
