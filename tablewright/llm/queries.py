"""Registered queries of the operators; each takes (spark, folder of parquet tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import (boilerplate, decontaminate, hamming, jaccard_join, katz, language, mixing, phrases, piece_encoding, sharding, toxicity,
               trie_counts, whitening)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _remainder(column: str, of: int) -> Column:
    """crc32 of a column's text, modulo."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def op1_katz(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored by a backoff model of nine tenths of them."""
    return katz.score_texts(_table(spark, folder, "documents"), _remainder("doc_id", 10) == 0, columns=["doc_id"])


def op2_token_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return jaccard_join.similarity_classes(_table(spark, folder, "documents"), columns=["doc_id"]).select(
        "doc_id", "n_shingles", "component_id")


def op3_differencing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 8 shards of nearly equal bytes."""
    return sharding.shard_documents(_table(spark, folder, "documents"), 8, columns=["doc_id"])


def op4_entropy_balancing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 of their sources."""
    return mixing.mix_sources(_table(spark, folder, "documents"), columns=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op5_evidence_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all pages, with trigrams of all documents."""
    return language.identify_pages(_table(spark, folder, "pages"), _table(spark, folder, "documents"))


def op6_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest sign codes of every 20th vector among all."""
    codes = _table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("embedding").isNotNull(), hamming.sign_code("embedding")).alias("code"))
    return hamming.nearest_codes(codes, codes.filter("id % 20 = 0"), k=10)


OP6_SQL = """
WITH rows_ AS (SELECT DISTINCT vec_id AS id, list_transform(range(1, 65), lambda i: coalesce(embedding[i], 0) > 0) AS signs
               FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT q.id AS query_id, r.id AS neighbor_id,
                 CAST(len(list_filter(range(1, 65), lambda i: q.signs[i] <> r.signs[i])) AS INTEGER) AS distance
          FROM rows_ q JOIN rows_ r ON q.id <> r.id WHERE q.id % 20 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank,
                  neighbor_id, distance FROM pairs)
SELECT * FROM ranked WHERE rank <= 10
"""


def op7_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate.overlap_report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_host_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return boilerplate.main_text(_table(spark, folder, "pages"), columns=["page_id", "url"])


def op9_counterfactual(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, learned from four fifths of the labels."""
    docs, labels = _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels")
    return toxicity.score_documents(docs, labels, _remainder("doc_id", 5) != 0).select(
        "doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_trie_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words and tokens of all documents."""
    return trie_counts.token_counts(_table(spark, folder, "documents"), columns=["doc_id"])


def op11_exact_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors whitened by the first 16 components of the distinct ones."""
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_piece_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded and decoded, with digests of ids, texts and source places."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return piece_encoding.encode(_table(spark, folder, "documents").select("doc_id", "text"), model, tokens=False).drop("text")


def op13_toivonen(spark: SparkSession, folder: str) -> DataFrame:
    """Collocations of all documents, by language."""
    return phrases.mine_phrases(_table(spark, folder, "documents"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
  THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

_RUNS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP7_SQL = f"""
WITH docs AS (SELECT doc_id, {_RUNS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_RUNS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS size,
  unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM items WHERE len(w) > 0),
places AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS b, w FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
grams AS (SELECT doc_id, size, b, array_to_string(w[b:b + size - 1], ' ') AS g FROM places),
found AS (SELECT doc_id, size, b, item FROM grams JOIN windows USING (size, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(b, b + size)) AS p FROM (SELECT DISTINCT doc_id, b, size FROM found)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""

OP13_SQL = f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, {_LOWERED} AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY 1),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
          FROM words, range(1, 6) s(size) WHERE len(w) >= size),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM counts),
longer AS (SELECT lang, phrase, max(f) AS g FROM (
  SELECT lang, array_to_string(w[1:size - 1], ' ') AS phrase, f FROM split WHERE size > 2 UNION ALL
  SELECT lang, array_to_string(w[2:size], ' '), f FROM split WHERE size > 2) GROUP BY ALL),
kept AS (SELECT s.* FROM split s LEFT JOIN longer o USING (lang, phrase) WHERE size > 1 AND (g IS NULL OR 100 * g < 100 * f)),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
scored AS (SELECT c.lang, c.phrase, k, c.f AS a, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN total t USING (lang) JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""

#: name: (query, SQL that must give the same rows or None)
QUERIES = {
    "op1_katz": (op1_katz, None),
    "op2_token_groups": (op2_token_groups, OP2_SQL),
    "op3_differencing": (op3_differencing, None),
    "op4_entropy_balancing": (op4_entropy_balancing, None),
    "op5_evidence_fusion": (op5_evidence_fusion, None),
    "op6_multi_index": (op6_multi_index, OP6_SQL),
    "op7_winnowing": (op7_winnowing, OP7_SQL),
    "op8_host_suffixes": (op8_host_suffixes, None),
    "op9_counterfactual": (op9_counterfactual, None),
    "op10_trie_counts": (op10_trie_counts, None),
    "op11_exact_whitening": (op11_exact_whitening, None),
    "op12_piece_offsets": (op12_piece_offsets, None),
    "op13_toivonen": (op13_toivonen, OP13_SQL),
}
