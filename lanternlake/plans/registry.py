"""The library's queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import index_queries, operations_queries, retrieval_queries, store_queries, symbol_queries, workflow_models, workflow_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return retrieval_queries.QUERIES | operations_queries.QUERIES | workflow_queries.QUERIES | index_queries.QUERIES | symbol_queries.QUERIES | store_queries.QUERIES | workflow_models.QUERIES


def oracle_sql() -> dict[str, str]:
    return retrieval_queries.SQL | operations_queries.SQL | workflow_queries.SQL | index_queries.SQL | symbol_queries.SQL | store_queries.SQL | workflow_models.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.hybrid_search(spark, sf_dir)
