"""Incremental ingestion: what a batch changes, section chunks, upserts, stale vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanternlake.functions.text import content_hash


def last_wins(batch: DataFrame, key: str = "id", order: str = "position") -> DataFrame:
    """Of rows with one id in a batch, the last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return batch.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def ingest_delta(batch: DataFrame, current: DataFrame, stale: DataFrame | None = None, reindex: bool = False) -> DataFrame:
    """(id, content_hash, status) for a batch (id, project_id, content) against the documents (id, project_id, content_hash).

    status: error (the id is another project's), new, changed, reembed (same text, but stale holds the id), skipped.
    """
    now = current.select("id", F.col("project_id").alias("old_project"), F.col("content_hash").alias("old_hash"))
    joined = batch.withColumn("content_hash", content_hash(F.col("content"))).join(now, "id", "left")
    status = (
        F.when(F.col("old_project").isNotNull() & (F.col("old_project") != F.col("project_id")), "error")
        .when(F.col("old_hash").isNull(), "new")
        .when(F.lit(reindex) | (F.col("old_hash") != F.col("content_hash")), "changed")
    )
    if stale is not None:
        joined = joined.join(stale.select("id", F.lit(True).alias("is_stale")).distinct(), "id", "left")
        status = status.when(F.coalesce("is_stale", F.lit(False)), "reembed")
    return joined.select("id", "content_hash", status.otherwise("skipped").alias("status"))


def upsert(current: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """current without the keys of new, and new: also how a document's chunks and vectors follow it (key document_id)."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stale_embeddings(chunks: DataFrame, vectors: DataFrame, version: str) -> DataFrame:
    """(chunk_id) of chunks without a vector of that model version."""
    return chunks.select("chunk_id").join(vectors.where(F.col("model_version") == version).select("chunk_id"), "chunk_id", "left_anti")


def section_chunks(docs: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(id, position, symbol, chunk): texts cut before lines that begin with # or ## and a space.

    The heading stays in its chunk and names it; what is before the first heading is a chunk if not blank. A text with one section or none
    is one chunk of the whole text.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    heading = lambda x: F.trim(x).rlike("^##? ")
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("whole"), lines.alias("lines"))
    begins = F.filter(F.sequence(F.lit(1), F.size("lines") - 1), lambda i: heading(F.get("lines", i)) & (i < F.size("lines")))
    cut = cut.withColumn("begins", F.when(F.size("lines") > 1, F.concat(F.array(F.lit(0)), begins)).otherwise(F.array(F.lit(0))))
    until = lambda k: F.coalesce(F.get("begins", k + 1), F.size("lines"))
    parts = F.transform("begins", lambda b, k: F.array_join(F.slice("lines", b + 1, until(k) - b), "\n"))
    parts = F.filter(parts, lambda x: F.regexp_replace(x, r"\s", "") != "")
    cut = cut.select("id", "whole", parts.alias("parts"))
    chosen = F.when(F.size("parts") <= 1, F.array("whole")).otherwise(F.col("parts"))
    out = cut.select("id", F.posexplode(chosen).alias("position", "chunk"))
    head = F.filter(F.split("chunk", "\n"), heading)
    symbol = F.trim(F.regexp_replace(F.trim(F.get(head, F.lit(0))), "^#+", ""))
    return out.select(F.col("id").alias(id_col), F.col("position").cast("int").alias("position"), symbol.alias("symbol"), "chunk")


# Beginnings of declarations in languages of curly braces (fixed values).
_TYPE = re.compile(r"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|export|default)\s+)*(class|interface|record|struct|enum)\s+(\w+)")
_METHOD = re.compile(r"^\s*(?:(?:public|private|protected|internal|static|async|override|virtual|sealed)\s+)+[\w<>\[\],.? ]+?\s+(\w+)\s*\([^;]*$")


def _code_pieces(text: str) -> list[tuple[str, str | None, str]]:
    """(chunk type, symbol, text): each type declaration whole, and each of its methods; without any, the file."""
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        kind, name = None, None
        if m := _TYPE.match(line):
            kind, name = m[1].capitalize(), m[2]
        elif m := _METHOD.match(line):
            kind, name = "Method", m[1]
        if kind:
            depth, end, opened = 0, i, False
            for end in range(i, len(lines)):
                depth += lines[end].count("{") - lines[end].count("}")
                opened |= "{" in lines[end]
                if opened and depth <= 0 or not opened and lines[end].rstrip().endswith(";"):
                    break
            out.append((kind, name, "\n".join(lines[i : end + 1])))
    return out or [("File", None, text)]


#: Characters of the chunks that leave a task at once.
PART_CHARS = 1 << 20


def code_chunks(docs: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(id, position, chunk_type, symbol, chunk) of source texts by the look of their declarations; texts without any are one File chunk."""

    def built(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.string()] * 3), strict=True))], ["id", "position", "chunk_type", "symbol", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time is taken apart, and what is made of a batch leaves in parts of some size.
            rows, size = [], 0
            for at in range(batch.num_rows):
                for k, piece in enumerate(_code_pieces(batch.column(1)[at].as_py() or "")):
                    rows.append((at, k, *piece))
                    size += len(piece[2])
                    if size >= PART_CHARS:
                        yield built(batch.column(0), rows)
                        rows, size = [], 0
            if rows:
                yield built(batch.column(0), rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, position int, chunk_type string, symbol string, chunk string").withColumnRenamed("id", id_col)


#: Chunkers by document type; others are cut by sections.
CHUNKERS = {"SourceCode": code_chunks, "Incident": section_chunks, "Runbook": section_chunks}
