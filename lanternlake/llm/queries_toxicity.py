"""The query on toxicity: op3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import table


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def fitted(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learns from the labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, fitted(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
