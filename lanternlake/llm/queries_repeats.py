"""Queries on repeated passages: op2 and op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import automaton, suffix_array
from .common import table


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_array.remove_repeats(docs, width=400, texts=False).drop("kept")


def op10_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return automaton.remove_repeats(docs, width=35, texts=False).drop("kept")


# All windows: SQL for small tables, which the operators must equal.
OP2_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS bytes, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), starts AS (
  SELECT doc_id, bytes, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400
), windows AS (
  SELECT doc_id, i, md5(bytes[i:i + 399]) AS s FROM starts
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1
), marked AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 400, true) AS fresh FROM again
), numbered AS (
  SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked
), span AS (
  SELECT doc_id, k, min(i) AS first, max(i) + 399 AS last FROM numbered GROUP BY doc_id, k
), piece AS (
  SELECT doc_id, first, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS before, last FROM span
), gone AS (
  SELECT doc_id, count(*) AS n_spans, sum(last - first + 1) AS n_removed, max(last) AS last,
         string_agg(substr(hex(bytes), 2 * before + 1, 2 * (first - 1 - before)), '' ORDER BY first) AS head
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN bytes ELSE unhex(head || substr(hex(bytes), 2 * gone.last + 1)) END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS s FROM starts
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1
), word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), judged AS (
  SELECT word.doc_id, word.word, word.i, again.i IS NOT NULL AND word.i - again.i < 35 AS gone
  FROM word ASOF LEFT JOIN again ON word.doc_id = again.doc_id AND word.i >= again.i
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
