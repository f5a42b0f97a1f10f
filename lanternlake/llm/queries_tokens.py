"""Queries on tokens: op4 and op9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, token_counts
from .common import table


def op4_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_edited(docs.withColumn("edits", token_counts.sample_edits(F.col("text"), F.col("doc_id"))), bpe.vocabulary_path())


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.vocabulary_path(), ids=False)
