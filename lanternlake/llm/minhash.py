"""Near-duplicate texts: min-max hashing, banding, and exact comparison of shingle sets.

Each permutation gives two values of a signature, the least and the greatest of a set's hashes, so half as many
permutations serve. Equal sets are one node from the start. Each set is first compared with the least and the
greatest id that it meets most; then, in buckets that hold several components, with a member of the first and of the
last. So a group of near copies costs a few pairs a set. What that leaves in buckets of several components is compared by odd
sketches, in blocks, inside the tasks (`_crossing`): a sketch never shows more differences than there are, so no link is lost, and only pairs
whose sketches are close leave the task. The same holds for buckets of every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mixed, saved, text_bytes, with_rows, word_bounds, word_ids
from .graph import components
from .runs import whole_runs

#: Bands of a signature and values in each: two sets of similarity 0.8 share no band once in two million times.
BANDS, ROWS = 36, 5

_RNG = np.random.default_rng(97)
_MULTIPLY = _RNG.integers(1, 2**32, BANDS * ROWS // 2, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, BANDS * ROWS // 2, dtype=np.uint32)
_PLACES = [np.uint64(int(x)) for x in _RNG.integers(1, 2**62, 64) * 2 + 1]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Members of a bucket that are compared in one task, and pairs and bytes of sketches that are compared at once.
BLOCK, PAIRS, SKETCH_BYTES = 1024, 1 << 17, 1 << 25


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of `width` words, A-Z in lower case; of all its words where there are fewer."""
    data = np.frombuffer(text, np.uint8)
    start, end = word_bounds(data)
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64)
    w = word_ids(_LOWER[data], start, end)
    k = min(n, width)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h += w[i : n - k + 1 + i] * _PLACES[i]
    return np.unique(mixed(h))


def band_keys(h: np.ndarray) -> np.ndarray:
    """The buckets of a set, one in each band. The values of one permutation go to bands of different halves."""
    half = BANDS * ROWS // 2
    low, high = np.full(half, 2**32 - 1, np.uint32), np.zeros(half, np.uint32)
    short = (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        x = short[at : at + 4096, None] * _MULTIPLY + _ADD
        x ^= x >> np.uint32(15)
        np.minimum(low, x.min(0), out=low)
        np.maximum(high, x.max(0), out=high)
    signature = np.concatenate([low, high]).astype(np.uint64).reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        out = np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            out = mixed(out + signature[:, i] * _PLACES[i])
    return out.view(np.int64)


def sketch(h: np.ndarray) -> np.ndarray:
    """A set's odd sketch: for each place of a power of two of them, n at least, whether an odd number of its n elements falls there.

    An element that only one of two sets has changes one place, so the sketches differ at no more places than the sets in elements.
    A sketch is made half as long by putting its halves together.
    """
    places = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, set_a, set_b, bands, sketch): size, hashes, buckets and sketch of each row's shingle set; sets without an element have no buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, first, second, bands, sketches = [], [], [], [], []
            for i in range(batch.num_rows):
                h = shingles(text_bytes(batch.column(1), i), width)
                size.append(len(h))
                with np.errstate(over="ignore"):
                    first.append(int(mixed(h).sum().view(np.int64)) if len(h) else 0)
                    second.append(int(mixed(h ^ _PLACES[0]).sum().view(np.int64)) if len(h) else 0)
                bands.append(band_keys(h) if len(h) else np.zeros(0, np.int64))
                sketches.append(sketch(h).tobytes() if len(h) else b"")
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists, pa.array(sketches, pa.binary())], ["id", "n", "set_a", "set_b", "bands", "sketch"])

    return docs.mapInArrow(run, "id bigint, n bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch binary")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, set): the hashes of each row's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ids, size = [], [], 0
            for i in range(batch.num_rows):
                held.append(shingles(text_bytes(batch.column(1), i), width).view(np.int64))
                ids.append(batch.column(0)[i])
                size += len(held[-1])
                if size > 1 << 20 or i == batch.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["id", "set"])
                    held, ids, size = [], [], 0

    return docs.mapInArrow(run, "id bigint, set array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) of which 100 * common >= percent * all elements, by their whole sets (id, set)."""
    pairs = saved(pairs.where(F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100).select("a", "b", "na", "nb").distinct(), "pairs")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    links = saved(both.select("a", "b", common.alias("common"), (F.col("na") + F.col("nb")).alias("total")).where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b"), "near-links")
    dropped(pairs)
    return links


def _pairs(rows: DataFrame, end: str) -> DataFrame:
    """(a, b, na, nb) of each row's (id, n) with its end's, the smaller id first; ends that are null or in the row's own component are left out."""
    fields = rows.schema[end].dataType.names
    rows = rows.where(F.col(f"{end}.id").isNotNull() & (F.col("component") != F.col(f"{end}.component") if "component" in fields else F.col("id") != F.col(f"{end}.id")))
    one, two = F.struct("id", "n"), F.struct(F.col(f"{end}.id").alias("id"), F.col(f"{end}.n").alias("n"))
    both = rows.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def _open_rows(crowd: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, n, component, k, members, low, high) of the members of buckets with more than one component (k of them); low and high are members of the first and last."""
    placed = saved(crowd.select("key", "id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    end = F.struct("component", "id", "n")
    parted = saved(placed.groupBy("key").agg(F.min(end).alias("low"), F.max(end).alias("high"), F.count_distinct("component").alias("k"), F.count("*").alias("members")).where("k > 1"), "mixed-buckets")
    out = saved(placed.join(parted, "key"), "open-rows")
    for x in (placed, parted):
        dropped(x)
    return out


def close_pairs(size: np.ndarray, n: np.ndarray, component: np.ndarray, sketches: list[bytes], percent: int, apart: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (a, b) of the rows that may be linked but are in different components, within runs of `size` rows.

    Two sets are linked only if they differ in (100 - percent) / (100 + percent) of all their elements at most; pairs whose sketches
    differ at more places are left out. apart: if given, a pair must differ in it, too, where it is not -1.
    """
    places = np.array([8 * len(x) for x in sketches])
    within = np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size)
    partners = np.repeat(size, size) - within - 1
    ends = np.cumsum(partners)
    begin = 0
    while begin < len(n):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        k = partners[begin:stop]
        a = np.repeat(np.arange(begin, stop), k)
        b = a + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k) + 1
        begin = stop
        keep = (component[a] != component[b]) & (np.maximum(n[a], n[b]) * percent <= np.minimum(n[a], n[b]) * 100)
        if apart is not None:
            keep &= (apart[a] < 0) | (apart[a] != apart[b])
        a, b = a[keep], b[keep]
        low = np.minimum(places[a], places[b])
        for m in np.unique(low).tolist():
            one, two = a[low == m], b[low == m]
            rows, at = np.unique(np.r_[one, two], return_inverse=True)
            words = np.stack([_folded(np.frombuffer(sketches[r], np.uint64), m // 64) for r in rows.tolist()])
            for c in range(0, len(one), step := max(1, SKETCH_BYTES // (m // 8))):
                x, y = at[c : min(c + step, len(one))], at[len(one) + c : len(one) + min(c + step, len(one))]
                odd = np.bitwise_count(words[x] ^ words[y]).sum(1, dtype=np.int64)
                close = odd * (100 + percent) <= (100 - percent) * (n[rows[x]] + n[rows[y]])
                yield rows[x[close]], rows[y[close]]


def _folded(words: np.ndarray, m: int) -> np.ndarray:
    while len(words) > m:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _crossing(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of the pairs of close sketches in different components, of rows (key, id, n, component, members, sketch); more than once if they meet in several buckets.

    A bucket of more than BLOCK members is cut into blocks, and each two blocks are a group of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, size in whole_runs(batches, ["key", "x", "y"]):
            ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
            apart = np.where(t.column("x").to_numpy() == t.column("y").to_numpy(), -1, t.column("own").to_numpy())
            for a, b in close_pairs(size, n, t.column("component").to_numpy(), t.column("sketch").to_pylist(), percent, apart):
                a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[a], ids[b], n[a], n[b])], ["a", "b", "na", "nb"])

    blocks = F.ceil(F.col("members") / BLOCK)
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "n", "component", "sketch")
    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row; kept marks the smallest id of each component.

    Texts are linked when the sets of their shingles (of `width` words) have a similarity of percent/100 or more; a component is all
    that links reach. Null and empty texts, and those without a word, have no shingle and are linked with nothing. Rows with equal
    ids are rows of their own, of a component one of them is kept; null ids come last, so a component is named by one only if it
    has no other. Equal sets are compared once, so a group of copies costs as much as one text. Other columns are not read.
    """
    docs, key_col = with_rows(docs.select(id_col, text_col), id_col)
    texts = docs.select(F.col(key_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    all_sets = saved(signatures(texts, width), "signatures")
    same = ["set_a", "set_b", "n"]
    nodes = saved(all_sets.where("n > 0").groupBy(same).agg(F.min("id").alias("node")), "set-nodes")
    member = all_sets.drop("bands", "sketch").join(nodes, same, "left")
    # One row in each band for each distinct set; a set's first row speaks for it.
    firsts = all_sets.drop("sketch").join(nodes.select(F.col("node").alias("id"), F.col("n").alias("n"), "set_a", "set_b"), ["id", *same]).dropDuplicates(["id"])
    bands = saved(firsts.select("id", "n", F.explode("bands").alias("key")), "bands")
    ends = F.struct("id", "n")
    buckets = saved(bands.groupBy("key").agg(F.min(ends).alias("low"), F.max(ends).alias("high"), F.count("*").alias("members")).where("members > 1"), "buckets")
    crowd = saved(bands.join(buckets, "key"), "bucket-members")
    # First two pairs a set at most: with the least and the greatest id that it meets in most buckets.
    ends_of = saved(crowd.groupBy("id", "n").agg(F.mode(F.when(F.col("low.id") < F.col("id"), F.col("low")), True).alias("low"), F.mode(F.when(F.col("high.id") > F.col("id"), F.col("high")), True).alias("high")), "bucket-ends")
    # Texts are dealt once: whatever is compared later is in a bucket with another.
    sets = saved(shingle_sets(texts.join(ends_of.select("id"), "id"), width), "sets")
    tried = saved(_pairs(ends_of, "low").unionByName(_pairs(ends_of, "high")).distinct(), "tried-pairs")
    links = _linked(tried, sets, percent)
    # Then, in buckets with more than one component, with a member of the first and of the last of them.
    open_rows = _open_rows(crowd, components(links))
    again = _pairs(open_rows, "low").unionByName(_pairs(open_rows, "high")).distinct()
    again = saved(again.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "tried-again")
    links = saved(links.unionByName(_linked(again, sets, percent)), "links-so-far")
    tried = tried.unionByName(again)
    # Last, what is still in buckets with more than one component.
    still = _open_rows(crowd, components(links)).select("key", "id", "n", "component", "members").join(all_sets.select("id", "sketch"), "id")
    cross = _crossing(still, percent).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    links = links.unionByName(_linked(cross, sets, percent))
    dropped(sets)
    found = components(links)
    out = member.join(found.withColumnRenamed("id", "node"), "node", "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "id").alias("component_id"))
    out = out.withColumn("kept", F.col("id") == F.col("component_id"))
    if key_col == id_col:
        return out.withColumnRenamed("id", id_col)
    names = docs.select(F.col(key_col).alias("id"), F.col(id_col).alias("name"))
    out = out.join(names, "id").join(names.select(F.col("id").alias("component_id"), F.col("name").alias("component_name")), "component_id")
    return out.select(F.col("name").alias(id_col), "n_shingles", F.col("component_name").alias("component_id"), "kept")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that near_duplicates() doesn't keep."""
    rows, key_col = with_rows(docs, id_col)
    gone = near_duplicates(rows, width, percent, key_col, text_col).where("not kept").select(key_col)
    return rows.join(gone, key_col, "left_anti").select(*docs.columns)
