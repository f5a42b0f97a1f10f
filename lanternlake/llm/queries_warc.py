"""The query on archives: op1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .common import shared_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC archives, these to WARC files in the shared folder, and those read again.

    Pages of equal ids are pages of their own; those without one come back without, as revisits where a page with an id has their payload. Where
    all pages of a payload lack an id, all are responses.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    body = F.coalesce("html", F.lit("")).cast("binary")
    repeated = warc.repeated_payloads(pages.select("page_id", F.sha2(body, 256).alias("payload_digest"), F.length(body).alias("payload_bytes")))
    path = shared_path(spark, "warc")
    longest = pages.agg(F.max(F.length(body)).alias("n")).first()["n"] or 0
    warc.write_warc(warc.mark_revisits(warc.convert_arc(warc.pack_arc(pages)), repeated), path, longest=longest)
    found = warc.read_warc(spark, path).where("warc_type <> 'warcinfo'")
    return found.select(F.col("key").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to_key").try_cast("long").alias("refers_to"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
