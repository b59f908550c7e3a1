"""Spelling variants and near-duplicate rows, against brute force in SQL."""

from pyspark.sql import functions as F

from tablewright.operators import similarity

from .tables import DIRTY_PARTS, dirty_parts, table


def _norm(c):
    return (f"lower(trim(regexp_replace(regexp_replace(strip_accents({c}), "
            f"'[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))")


def _close(a, b, distance, long_share, short_share="0.20"):
    longer = f"greatest(length({a}), length({b}))"
    return (f"levenshtein({a}, {b}) <= {distance} AND levenshtein({a}, {b})::DOUBLE / {longer} <= "
            f"CASE WHEN {longer} <= 6 THEN {short_share}::DOUBLE ELSE {long_share}::DOUBLE END")


def _merge_sql(source, column):
    """The sequential greedy pass itself: one form after the other against the leaders so far."""
    return f"""WITH RECURSIVE c AS MATERIALIZED (SELECT {column} AS value, count(*) AS n, {_norm(column)} AS norm
  FROM ({source}) WHERE {column} IS NOT NULL GROUP BY 1),
f AS MATERIALIZED (SELECT norm, arg_min(value, (-n, value)) AS value, row_number() OVER
  (ORDER BY min((-n, value))) AS rn FROM c WHERE norm <> '' GROUP BY norm),
s AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS found, CAST(NULL AS VARCHAR) AS norm,
    CAST(NULL AS VARCHAR) AS leader
  UNION ALL
  SELECT f.rn, CASE WHEN len(near) > 0 THEN found ELSE list_append(found, f.norm) END, f.norm,
    CASE WHEN len(near) > 0 THEN near[1] ELSE f.norm END
  FROM (SELECT s.rn AS prior, s.found, f.norm, f.rn, f.value,
          list_filter(s.found, lambda l: {_close('f.norm', 'l', 2, '0.30')}) AS near
        FROM s JOIN f ON f.rn = s.rn + 1) f)
SELECT c.value, f.value AS canonical FROM c JOIN s ON c.norm = s.norm JOIN f ON f.norm = s.leader"""


def _pairs_sql(items, distance, long_share):
    return f"""WITH i AS MATERIALIZED ({items}),
p AS MATERIALIZED (SELECT a.id AS id_a, b.id AS id_b, a.text AS text_a, b.text AS text_b
  FROM i a JOIN i b ON a.id < b.id AND abs(length(a.text) - length(b.text)) <= {distance}),
l AS MATERIALIZED (SELECT id_a, id_b, levenshtein(text_a, text_b) AS distance,
  greatest(length(text_a), length(text_b)) AS longer FROM p)
SELECT id_a, id_b, CAST(distance AS INTEGER) AS distance FROM l
WHERE distance <= {distance} AND distance::DOUBLE / longer <=
  CASE WHEN longer <= 6 THEN 0.20::DOUBLE ELSE {long_share}::DOUBLE END"""


def _signature_sql(source, row_id, columns):
    raw = " || ' ' || ".join(f"coalesce({c}, '')" for c in columns)
    return f"""SELECT min(id) AS id, text FROM (SELECT {row_id} AS id, {_norm(raw)} AS text
  FROM {source}) WHERE text <> '' GROUP BY text"""


def _value_pairs(spark, folder):
    values = dirty_parts(spark, folder).select(F.col("part_name").alias("id")).distinct()
    return similarity.close_pairs(values.select("id", F.col("id").alias("text")),
                                  similarity.VALUES)


def _row_pairs(spark, folder):
    documents = table(spark, folder, "documents")
    return similarity.close_pairs(similarity.row_signatures(documents, "doc_id"),
                                  similarity.ROWS)


def _near_rows(spark, folder):
    return similarity.near_duplicate_rows(dirty_parts(spark, folder), "p_partkey")


NEAR_ROWS_SQL = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT p_partkey AS id, {_norm(
    "part_type || ' ' || part_name || ' ' || p_brand")} AS norm FROM ({DIRTY_PARTS})),
f AS MATERIALIZED (SELECT norm, min(id) AS id, row_number() OVER (ORDER BY min(id)) AS rn FROM r GROUP BY norm),
q AS MATERIALIZED (SELECT b.rn, a.rn AS earlier, levenshtein(a.norm, b.norm) AS edits,
  greatest(length(a.norm), length(b.norm)) AS longer FROM f a JOIN f b ON a.rn < b.rn
  AND abs(length(a.norm) - length(b.norm)) <= 3),
p AS MATERIALIZED (SELECT rn, earlier FROM q WHERE edits <= 3 AND edits::DOUBLE / longer <=
  CASE WHEN longer <= 6 THEN 0.20::DOUBLE ELSE 0.15::DOUBLE END),
n AS MATERIALIZED (SELECT f.rn, coalesce(list(p.earlier ORDER BY p.earlier) FILTER (WHERE p.earlier IS NOT NULL),
  []) AS earlier FROM f LEFT JOIN p ON p.rn = f.rn GROUP BY f.rn),
s AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS found, CAST(0 AS BIGINT) AS leader
  UNION ALL
  SELECT n.rn, CASE WHEN len(list_intersect(s.found, n.earlier)) > 0 THEN s.found
      ELSE list_append(s.found, n.rn) END,
    coalesce(list_min(list_intersect(s.found, n.earlier)), n.rn)
  FROM s JOIN n ON n.rn = s.rn + 1)
SELECT r.id AS row_id, l.id AS cluster_id FROM r JOIN f USING (norm) JOIN s ON s.rn = f.rn
JOIN f l ON l.rn = s.leader WHERE s.leader IN (SELECT leader FROM s WHERE leader <> rn AND rn > 0)"""

QUERIES = {
    "fuzzy_merge": (
        lambda s, d: similarity.spelling_map(dirty_parts(s, d), "part_type"),
        _merge_sql(DIRTY_PARTS, "part_type")),
    "fuzzy_merge_names": (
        lambda s, d: similarity.spelling_map(dirty_parts(s, d), "part_name"),
        _merge_sql(DIRTY_PARTS, "part_name")),
    "close_value_pairs": (
        _value_pairs,
        _pairs_sql(f"SELECT DISTINCT part_name AS id, part_name AS text FROM ({DIRTY_PARTS})",
                   2, "0.30")),
    "near_duplicate_pairs": (
        _row_pairs,
        _pairs_sql(_signature_sql("documents", "doc_id", ["text", "lang", "source"]), 3, "0.15")),
    "near_duplicate_rows": (_near_rows, NEAR_ROWS_SQL),
}
