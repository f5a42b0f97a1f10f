"""Ingestion as a stream: files of JSON lines go batch by batch into a store, what can't be read goes to its rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlake.functions.text import content_hash
from lanternlake.operators import ingest as I
from lanternlake.operators import sinks as W
from lanternlake.storage import checkpointed

DOCUMENT = "document_id bigint, project_id string, content string"
CORRUPT = "_corrupt_record"


def document_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """A stream of the documents in a folder's files of JSON lines, at most `files` files a batch; a line that can't be read is in _corrupt_record."""
    reader = spark.readStream.schema(f"{DOCUMENT}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE")
    return reader.option("maxFilesPerTrigger", files).json(folder)


def what_is_wrong() -> F.Column:
    """Why a row of a batch is no document, null if it is one."""
    return (
        F.when(F.col(CORRUPT).isNotNull(), "no JSON of a document").when(F.col("document_id").isNull(), "no document id")
        .when(F.trim(F.coalesce("project_id", F.lit(""))) == "", "no project").when(F.trim(F.coalesce("content", F.lit(""))) == "", "no content")
    )


def into_store(path: str) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch: its good documents, the last row of each id, come into the store at path under the batch's number, the others
    become rejects. A batch that is run again, after a failure at any point, leaves the same documents, rejects and ledger.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = checkpointed(batch.withColumn("position", F.monotonically_increasing_id()).withColumn("reason", what_is_wrong()))
        good = I.last_wins(rows.where("reason is null").select("document_id", "project_id", "content", "position"), "document_id").drop("position")
        held = W.table(batch.sparkSession, path, "documents", DOCUMENT).select(F.col("document_id").alias("id"), "project_id", content_hash(F.col("content")).alias("content_hash"))
        status = I.ingest_delta(good.withColumnRenamed("document_id", "id"), held).select(F.col("id").alias("document_id"), "status")
        bad = rows.where("reason is not null").select(F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("id"), F.when(F.col(CORRUPT).isNull(), F.col("reason")).otherwise(F.concat("reason", F.lit(": "), F.substring(CORRUPT, 1, 200))).alias("reason"))
        chunks = I.section_chunks(good).select("document_id", "position", "chunk")
        W.ingest(path, f"batch-{number}", status, good, chunks, rejects=bad)

    return apply
