"""A store of documents, chunks and vectors that ingestions change, and run again without changing it further.

Each table lies in buckets by document. An ingestion rewrites the buckets that hold one of its documents: first to a folder of its own, then,
when all tables are there, their folders are moved in place of the old ones. What it can't take goes to a table of rejects, and what it did to a ledger, each under its batch.
If it fails at any point it is run again; rows are replaced by id, so the state is the same as after one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlake.operators.workflow import as_json
from lanternlake.storage import checkpointed, exists, moved, removed, stored

BUCKETS = 32

#: What an ingestion does to a document, and which of these take its rows away or bring new ones.
GONE, COME = ("new", "changed", "deleted", "reembed"), ("new", "changed", "reembed")

REJECTS = "kind string, id string, reason string, batch string"
LEDGER = "status string, n bigint, batch string"


def _bucket(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(BUCKETS)).cast("int")


def table(spark: SparkSession, path: str, name: str, schema: str, id_col: str = "document_id", buckets: list[int] | None = None) -> DataFrame:
    """A table of the store, without rows before the first ingestion. schema: its columns, without the bucket. buckets: those to read, all unless given."""
    if not exists(spark, f"{path}/{name}") or buckets == []:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/{name}").where(F.col(id_col).isNotNull())
    return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")


def _staged(path: str, name: str, new: DataFrame, status: DataFrame, batch: str, id_col: str, gone: tuple[str, ...], come: tuple[str, ...]) -> None:
    """Writes the touched buckets of a table as they will be, to a folder of the batch."""
    spark, schema = new.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    touched = status.where(F.col("status").isin(*gone)).select(id_col).distinct()
    written = status.where(F.col("status").isin(*come)).select(id_col).distinct()
    # At most BUCKETS numbers: only these are read and written.
    numbers = [r[0] for r in touched.select(_bucket(id_col).alias("b")).distinct().collect()]
    come_to = [r[0] for r in written.select(_bucket(id_col).alias("b")).distinct().collect()]
    # Rows are shuffled once, by id to meet the status, and each task writes its part of each bucket.
    parts = []
    if numbers and exists(spark, f"{path}/{name}"):
        parts.append(table(spark, path, name, schema, id_col, numbers).join(touched, id_col, "left_anti"))
    if come_to:
        parts.append(new.where(_bucket(id_col).isin(come_to)).join(written, id_col, "left_semi"))
    # A row without id keeps a bucket's place when all its documents go.
    rows = spark.createDataFrame([(n,) for n in numbers], "bucket int").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema), "bucket")
    for part in parts:
        rows = rows.unionByName(part.select(new.columns).withColumn("bucket", _bucket(id_col)))
    to = f"{path}/_staged/{batch}/{name}"
    # What an earlier run of the batch staged goes.
    removed(spark, to)
    stored(rows, to, "bucket")


def _put(spark: SparkSession, path: str, batch: str, name: str) -> None:
    """Moves what is staged of a table in place, after a mark that it is whole: a failure in between is mended from there."""
    mark = f"{path}/_staged/{batch}/{name}-whole"
    if not exists(spark, mark):
        stored(spark.range(1), mark)
    moved(spark, f"{path}/_staged/{batch}/{name}", f"{path}/{name}")
    removed(spark, mark)


def ingest(path: str, batch: str, status: DataFrame, documents: DataFrame, chunks: DataFrame | None = None, vectors: DataFrame | None = None, rejects: DataFrame | None = None, id_col: str = "document_id") -> None:
    """Brings a batch into the store at path.

    status: (document id, status), as ingest_delta() has it and deleted. documents, chunks, vectors: rows with the document's id; of these the
    ones of documents that are new or changed are written, and all that these and deleted documents had before goes; reembed replaces vectors alone.
    rejects: (kind, id, reason) of what was left out elsewhere; documents in error are added. Rows without a document id are rejected. Null status and repeated
    rows of status count once. Tables that aren't given stay as they are.
    """
    status = checkpointed(status.select(id_col, "status").distinct())
    spark = status.sparkSession
    for name in ("documents", "chunks", "vectors"):
        if exists(spark, f"{path}/_staged/{batch}/{name}-whole"):
            _put(spark, path, batch, name)
    parts = {"documents": (documents, ("new", "changed", "deleted"), ("new", "changed"))}
    if chunks is not None:
        parts["chunks"] = (chunks, *parts["documents"][1:])
    if vectors is not None:
        parts["vectors"] = (vectors, GONE, COME)
    refused = status.where("status = 'error'").select(F.lit("document").alias("kind"), F.col(id_col).cast("string").alias("id"), F.lit("the document is another project's").alias("reason"))
    for name, (rows, _, _) in parts.items():
        refused = refused.unionByName(rows.where(F.col(id_col).isNull()).select(F.lit(name).alias("kind"), F.lit(None).cast("string").alias("id"), F.lit("no document id").alias("reason")))
    if rejects is not None:
        refused = refused.unionByName(rejects.select("kind", F.col("id").cast("string").alias("id"), "reason"))
    for name, (rows, gone, come) in parts.items():
        _staged(path, name, rows, status.where(F.col(id_col).isNotNull()), batch, id_col, gone, come)
    stored(refused.withColumn("batch", F.lit(batch)), f"{path}/rejects", "batch")
    for name in parts:
        _put(spark, path, batch, name)
    stored(status.groupBy("status").agg(F.count("*").alias("n")).withColumn("batch", F.lit(batch)), f"{path}/ledger", "batch")


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, reason, batch) of all that was left out."""
    return _batches(spark, f"{path}/rejects", REJECTS)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(status, n, batch): how many documents each batch that was ended had in each status."""
    return _batches(spark, f"{path}/ledger", LEDGER)


def save_json(df: DataFrame, path: str, key: str, batch: str) -> None:
    """Rows of runs, traces or results as lines of JSON (key, json) under their batch, in place of what an earlier run of it wrote."""
    as_json(df, key).withColumnRenamed(key, "key").withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)


def load_json(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """(key, json, batch) of what save_json() wrote under path."""
    return spark.read.schema(f"key {key_type}, json string, batch string").json(path)
