"""Tables in folders that driver and executors share: cutting a plan's lineage, and writing what can be written again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is named, a temporary folder on a local master, as in tests, and an error elsewhere."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        # local-cluster[...] has executors of its own, which don't share a temporary folder.
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lanternlake-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed and kept in the cluster's checkpoint folder, so that what follows neither repeats it nor carries its plan.

    The folder is the session's spark.checkpoint.dir; where none is named, a temporary one on a local master, as in tests, and an error elsewhere.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path beside the checkpoints, deleted when the application ends."""
    path = f"{_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stored(df: DataFrame, path: str, *partitions: str) -> None:
    """Writes df to path in place of the partitions that it has rows of, or of all that is there if it isn't partitioned; others stay. Run again, it leaves the same."""
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    writer.parquet(path)


def moved(spark: SparkSession, path: str, to: str) -> None:
    """The partition folders of the table at path in place of those of the same names at another; others stay. Run again after a failure, it moves those that are left."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at(to))
    for entry in files.listStatus(at(path)):
        name = entry.getPath().getName()
        if "=" in name:
            files.delete(at(to, name), True)
            if not files.rename(entry.getPath(), at(to, name)):
                raise OSError(f"{name} can't be moved from {path} to {to}")


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """The distinct rows of df, written once in buckets by key in the shared folder: joins by key don't shuffle them again. The table's name goes at the end, so what is made of it must be computed before."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"bucketed_{uuid.uuid4().hex}"
    # Dealt by key, equal rows meet: the distinct needs no other shuffle.
    df.repartition(n, key).distinct().write.bucketBy(n, key).option("path", new_folder(spark, "bucketed")).format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def kept(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """df, written once in buckets by key, n or as many as the session's shuffle partitions, in the shared folder and read again: what is grouped by key, or by key and more, isn't shuffled again, and within local_keys() no join is.

    Equal keys should lie together in df already, else a bucket is a file of each task. The files take a fraction of a checkpoint's, which are neither encoded nor compressed.
    """
    spark = df.sparkSession
    name = f"kept_{uuid.uuid4().hex}"
    df.write.bucketBy(n or _partitions(spark), key).option("path", new_folder(spark, "kept")).option("compression", "zstd").format("parquet").saveAsTable(name)
    found = spark.table(name)
    # The name alone goes: a table with a path leaves its files, which the application deletes when it ends.
    spark.sql(f"DROP TABLE {name}")
    return found


def dealt(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """df shuffled by key into as many partitions as kept() has buckets."""
    return df.repartition(n or _partitions(df.sparkSession), key)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def local_keys(spark: SparkSession) -> Iterator[None]:
    """What is computed inside joins rows where they lie if one of the join's columns dealt them out, on both sides alike, not only if all of them did."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
