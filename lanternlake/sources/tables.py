"""Readers: the driver's tables as the engine's records, and the corpus, golden-set and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_TYPES = ("SourceCode", "Incident", "Runbook", "DeploymentRecord")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scoped(df: DataFrame, project: str | Column) -> DataFrame:
    """Only the rows of a project: what every accessor of project data applies first."""
    return df.where(F.col("project_id") == (F.lit(project) if isinstance(project, str) else project))


def live(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(F.col(deleted).isNull())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as evidence chunks of one document each."""
    n = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.lit("p"), n % 5).alias("project_id"),
        F.get(F.array(*map(F.lit, DOCUMENT_TYPES)), (n % 4).cast("int")).alias("document_type"),
        F.col("source").alias("service"),
        F.col("lang").alias("language"),
        F.concat("source", F.lit("/"), n, F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )


DOCUMENTS_SQL = """docs AS (
  SELECT doc_id AS chunk_id, 'p' || (doc_id % 5) AS project_id,
         ['SourceCode', 'Incident', 'Runbook', 'DeploymentRecord'][(doc_id % 4 + 1)::INT] AS document_type,
         source AS service, lang AS language, source || '/' || doc_id || '.txt' AS path, text AS content
  FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as the vectors of the chunks with the same id, two model versions among them."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 10 == 0, "v1").otherwise("v2").alias("model_version"), F.col("embedding").alias("vector"), "label")


VECTORS_SQL = "vecs AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 10 = 0 THEN 'v1' ELSE 'v2' END AS model_version, embedding::DOUBLE[] AS vector, label FROM embeddings)"


# ---------------------------------------------------------------- files


def code_files(spark: SparkSession, folder: str, project: str, pattern: str = "*.cs") -> DataFrame:
    """(id, project_id, document_type, path, title, content) of all source files under a folder, build output and empty files left out."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select("value", F.col("_metadata.file_path").alias("file"))
    root = folder.rstrip("/").removeprefix("file:") + "/"
    path = F.element_at(F.split("file", root, 2), -1)
    kept = ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ("bin", "obj", ".git", ".vs"))))
    return raw.select(path.alias("path"), F.col("value").alias("content")).where(kept).select(F.concat(F.lit(f"{project}:code:"), "path").alias("id"), F.lit(project).alias("project_id"), F.lit("SourceCode").alias("document_type"), "path", F.element_at(F.split("path", "/"), -1).alias("title"), "content")


def markdown_files(spark: SparkSession, folder: str, project: str, document_type: str) -> DataFrame:
    """(id, project_id, document_type, path, title, content) of a folder's markdown files; the title is the first line without its #."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("value").alias("content"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("path"))
    title = F.trim(F.regexp_replace(F.substring_index("content", "\n", 1), "^#+", ""))
    stem = F.regexp_replace("path", r"\.md$", "")
    return raw.select(F.concat(F.lit(f"{project}:{document_type.lower()}:"), stem).alias("id"), F.lit(project).alias("project_id"), F.lit(document_type).alias("document_type"), "path", title.alias("title"), "content")


GOLDEN = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("schema_version", T.StringType()),
    T.StructField("cases", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("expected_evidence", T.ArrayType(T.StringType())),
        T.StructField("archetype", T.StringType()), T.StructField("difficulty", T.StringType()), T.StructField("notes", T.StringType()),
    ]))),
])


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """(version, id, query, expected_evidence, ...) of a golden file; cases without id or query are left out, blanks dropped, strings trimmed."""
    raw = spark.read.schema(GOLDEN).json(path, multiLine=True)
    cases = raw.select(F.coalesce("version", "schema_version", F.lit("unknown")).alias("version"), F.explode("cases").alias("c"))
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    gold = F.filter(F.transform(F.coalesce("c.expected_evidence", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    out = cases.select("version", trimmed(F.col("c.id")).alias("id"), trimmed(F.col("c.query")).alias("query"), gold.alias("expected_evidence"), *(trimmed(F.col(f"c.{k}")).alias(k) for k in ("archetype", "difficulty", "notes")))
    return out.where("id is not null and query is not null")


BASELINE = "leg string, k int, metric string, value double"


def baseline_report(spark: SparkSession, path: str) -> DataFrame:
    """(leg, k, metric, value) of an earlier report, no rows where there is none or it can't be read."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], BASELINE)
    return spark.read.schema(BASELINE).option("mode", "DROPMALFORMED").json(path).where("leg is not null and metric is not null")


def target_state(disk: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, content): files on disk under what a change makes of them, which wins; files that the change deletes (null content) go."""
    over = changed.select("path", F.col("content").alias("new"), F.lit(True).alias("touched"))
    joined = disk.select("path", "content").join(over, "path", "full_outer")
    return joined.select("path", F.when(F.coalesce("touched", F.lit(False)), F.col("new")).otherwise(F.col("content")).alias("content")).where("content is not null")
