"""What several operators of this subpackage share: tables, shared files, word and byte hashing."""

from __future__ import annotations

import functools
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the runs of characters other than space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach; where none is named, a temporary one on a local master, as in tests, and an error elsewhere."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        # local-cluster[...] has executors of its own, which don't share a temporary folder.
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lanternlake-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/lanternlake-{sc.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that saved() wrote."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def with_rows(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """df and the name of a column of unique bigint keys, in the order of the ids: the ids themselves where they are integers, unique and not null.

    Otherwise the rows are put in order of id, null last, numbered, and written to the shared folder: so repeated and null ids are rows of their own.
    """
    if df.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        n = df.agg(F.count("*").alias("rows"), F.count_distinct(id_col).alias("ids")).first()
        if n.rows == n.ids:
            return df, id_col
    name = "row_key"
    while name in df.columns:
        name += "_"
    # The second key parts rows of equal ids, so that a third of all ids being null is no task's alone.
    place = F.monotonically_increasing_id()
    return saved(df.withColumn(name, place).orderBy(F.col(id_col).asc_nulls_last(), name).withColumn(name, place), "rows"), name


def words(text) -> F.Column:
    """The array of words of a text column, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


# Hashing in numpy. Every byte gets a fixed random odd number; a string's hash is a polynomial of them modulo 2**64, mixed. Long strings
# of a regular structure can collide, so these hashes choose places and deal rows; what is taken for equal has equal digests().
_SEED = np.random.default_rng(20240607)
BYTE_TABLE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = int(_SEED.integers(2**40, 2**62)) | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


#: Powers that a task keeps of each base.
POWERS = 1 << 16


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    m = 1
    with np.errstate(over="ignore"):
        while m < n:
            out[m : 2 * m] = out[: min(m, n - m)] * np.uint64(pow(base, m, 2**64))
            m *= 2
    return out[:n]


@functools.cache
def _kept_powers(base: int) -> np.ndarray:
    return _powers(POWERS, base)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    return _kept_powers(base)[:n] if n <= POWERS else _powers(n, base)


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values[i] * BASE**i before each place, and BASE**-i: what sliding_hash() needs."""
    n = len(values)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n), out=sums[1:])
    return sums, powers(n + 1, BASE_INVERSE)


def sliding_hash(prefix: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """The hashes of all runs of `width` values."""
    sums, inverse = prefix
    with np.errstate(over="ignore"):
        return mixed((sums[width:] - sums[:-width]) * inverse[: len(sums) - width] + np.uint64(width) * _M2)


#: Bytes that end a word.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text's bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: Bytes of a word up to which it is hashed in numpy; longer ones, which are rare, get a digest.
SHORT_WORD = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that start and end there.

    Eight bytes at a time are mixed in by a bijection, so words of up to eight bytes collide with none of their length, and no
    structure of a word's bytes carries through, as it does in polynomials modulo a power of two.
    """
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    # The eight bytes from each place on, without a copy.
    eight = np.ndarray(len(data), "<u8", padded, strides=(1,)) if len(data) else np.zeros(0, np.uint64)
    h = mixed(size.astype(np.uint64) + _M1)
    for at in range(0, min(int(size.max(initial=0)), SHORT_WORD), 8):
        who = np.flatnonzero((size > at) & (size <= SHORT_WORD))
        h[who] = mixed(h[who] ^ (eight[start[who] + at] & _KEEP[np.minimum(size[who] - at, 8)]))
    for k in np.flatnonzero(size > SHORT_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return h


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of data[start:end], as rows of two bigints: what is grouped by them is equal."""
    view = memoryview(data)
    out = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def binary_column(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as an Arrow column of their bytes."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def text_bytes(column, i: int) -> bytes:
    """The bytes of row i of an Arrow binary or string column, empty for null."""
    buffer = column[i].as_buffer()
    return b"" if buffer is None else buffer.to_pybytes()
