"""A corpus from documents to tokens: toxic texts go, one of each group of near copies stays, repeated passages are cut out,
the sources are mixed to their weights, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlake.llm import bpe, minhash, mixing, suffix_array, toxicity
from lanternlake.llm.common import saved, table
from lanternlake.llm.queries_toxicity import fitted


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that a model of the labels rejects. Null and empty texts are kept, repeated rows and null ids are rows of their own, no rows give none."""
    return toxicity.keep_clean(docs, fitted(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by a similarity of 0.8 of the sets of five-word shingles.

    Texts without a word, null ones too, are linked with nothing and kept, each of them. Of repeated rows one stays, of rows with equal ids the one that
    comes first; a null id stays only where its group has no other.
    """
    return minhash.keep_one(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out all strings of 400 bytes that occur twice; a document of nothing else stays with an empty text.

    Null texts stay null, shorter ones as they are; rows with equal or null ids are rows of their own, so repeated long rows are emptied.
    """
    return _measured(suffix_array.cut(docs, width=400))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources by weight at 150 % of all words; documents taken more than once are repeated.

    Documents without a word, null ones too, are left out. A null source is one of its own, the last; rows with equal or null ids are rows of their own.
    """
    return _measured(mixing.apply_mix(docs))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: their number, and digests of the ids and of the text decoded from them. A null text is empty; each row has its own result."""
    return bpe.encode_documents(docs, bpe.vocabulary_path(), ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: Training, hashing and byte-pair merges are no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
