"""Versioned files as a data source: a folder for each revision, and the working tree as one of them.

`register(spark)`, then `spark.read.format("revisions").load(root)` gives (rev, path, content, warning), a task some files at a time; conditions on rev
and on path decide which folders are listed and which files are opened. `df.write.format("revisions").save(root)` writes rows
(rev, path, content). Folders are reached through Arrow's file systems, so a root may be a local path or a store's address.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from lanternlake.sources.tables import target_state

#: The name of the working tree among the revisions, files that a task opens, and folders that hold no source.
WORKING_TREE, FILES_A_TASK = "worktree", 200
BUILD_FOLDERS = ("bin", "obj", ".git", ".vs")


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root.rstrip("/"))


@dataclass
class Files(InputPartition):
    """(rev, path) of some files."""

    names: list[tuple[str, str]]

    def __init__(self, names: list[tuple[str, str]]):
        super().__init__(None)
        self.names = names


class RevisionReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.revs, self.paths, self.begins = root, None, None, ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions that name revisions or paths; the others are Spark's."""
        for f in filters:
            column = getattr(f, "attribute", None)
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if column == ("rev",) and values is not None:
                self.revs = set(values) if self.revs is None else self.revs & set(values)
            elif column == ("path",) and values is not None:
                self.paths = set(values) if self.paths is None else self.paths & set(values)
            elif column == ("path",) and isinstance(f, StringStartsWith) and f.value.startswith(self.begins):
                self.begins = f.value
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = _opened(self.root)
        revs = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory)
        names = []
        for rev in revs:
            if self.revs is not None and rev not in self.revs:
                continue
            if self.paths is not None:
                wanted = sorted(p for p in self.paths if p and p.startswith(self.begins))
                found = zip(wanted, store.get_file_info([f"{root}/{rev}/{p}" for p in wanted]), strict=True)
                names += [(rev, p) for p, f in found if f.type == fs.FileType.File]
            else:
                at = len(f"{root}/{rev}/")
                found = (f.path[at:] for f in store.get_file_info(fs.FileSelector(f"{root}/{rev}", recursive=True)) if f.type == fs.FileType.File)
                names += [(rev, p) for p in sorted(found) if p.startswith(self.begins)]
        names = [(rev, p) for rev, p in names if not set(p.split("/")) & set(BUILD_FOLDERS)]
        return [Files(names[k : k + FILES_A_TASK]) for k in range(0, len(names), FILES_A_TASK)]

    def read(self, partition: Files | None) -> Iterator[tuple]:
        store, root = _opened(self.root)
        # Where there is no file, Spark asks once without a partition.
        for rev, path in partition.names if partition else ():
            try:
                with store.open_input_stream(f"{root}/{rev}/{path}") as stream:
                    yield rev, path, stream.read().decode("utf-8"), None
            except UnicodeDecodeError:
                yield rev, path, None, f"{path} is no text"
            except FileNotFoundError:
                yield rev, path, None, f"{path} is gone"


class RevisionWriter(DataSourceWriter):
    """Each row becomes a file under a name of its own first, which is then moved to its place: a task that is run again writes the same."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = _opened(self.root)
        for row in rows:
            if row["rev"] is None or row["path"] is None or row["content"] is None:
                raise ValueError("a file needs its revision, its path and a content")
            if ".." in row["path"].split("/") or row["path"].startswith("/"):
                raise ValueError(f"a path must lie in its revision: {row['path']}")
            folder, _, name = f"{root}/{row['rev']}/{row['path']}".rpartition("/")
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/.{name}.part") as stream:
                stream.write(row["content"].encode())
            store.move(f"{folder}/.{name}.part", f"{folder}/{name}")
        return WriterCommitMessage()


class RevisionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "revisions"

    def schema(self) -> str:
        return "rev string, path string, content string, warning string"

    def reader(self, schema) -> RevisionReader:
        return RevisionReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> RevisionWriter:
        return RevisionWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it take conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RevisionSource)


def revision(spark: SparkSession, root: str, rev: str | None) -> DataFrame:
    """(path, content, warning) of a revision's files; None is the working tree."""
    register(spark)
    return spark.read.format("revisions").load(root).where(F.col("rev") == (rev or WORKING_TREE)).select("path", "content", "warning")


def resolved_change(spark: SparkSession, root: str, files: DataFrame, base: str, target: str | None = None) -> DataFrame:
    """(path, base_content, target_content, warning) of the files (path) of a change: as they were at base and are at target, null where they are missing.

    target None: the working tree. warning says what can't be read, or that neither side has a file. Paths count once, null ones are left out.
    """
    a, b = (revision(spark, root, r).select("path", F.col("content").alias(f"{n}_content"), F.col("warning").alias(f"{n}_warning"), F.lit(True).alias(f"{n}_there")) for r, n in ((base, "base"), (target, "target")))
    both = files.select("path").where("path is not null").distinct().join(a, "path", "left").join(b, "path", "left")
    missing = F.when(F.col("base_there").isNull() & F.col("target_there").isNull(), F.concat(F.lit("No content for "), "path"))
    return both.select("path", "base_content", "target_content", F.coalesce("target_warning", "base_warning", missing).alias("warning"))


def state_after(spark: SparkSession, root: str, change: DataFrame) -> DataFrame:
    """(path, content): the working tree with what a change (path, target_content) makes of its files; those that it deletes are left out."""
    return target_state(revision(spark, root, None).select("path", "content"), change.select("path", F.col("target_content").alias("content")))
