"""The queries in DataFrame operations only: op6 and op8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, quality
from .common import table


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.text_size().alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH rows AS (
  SELECT doc_id, source IS NULL AS null_source, coalesce(source, '') AS source_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT null_source, source_key, sum(size)::BIGINT AS source_size FROM rows GROUP BY ALL
), weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY null_source, source_key) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ()) AS wanted
  FROM sources
), leveled AS (
  SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY cap / weight, null_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, null_source, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT null_source, source_key, source_size,
         CASE WHEN max(CASE WHEN level * weight < cap THEN level END) OVER () IS NULL THEN cap
              ELSE least(cap, (max(CASE WHEN level * weight < cap THEN level END) OVER ()) * weight) END AS target
  FROM leveled
), placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(r.size) OVER (PARTITION BY r.null_source, r.source_key ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it
  FROM rows r JOIN targets t USING (null_source, source_key)
)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(round(target - whole * source_size)::BIGINT - before_it, 0)))::BIGINT AS taken
FROM placed
"""
