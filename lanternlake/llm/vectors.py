"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, then exact cosines.

A table's hash is a few random projections of the normalised vector, cut into cells of a fixed width; vectors that
share all cells of a table meet in a bucket. A pair is counted in the first table that brings it together, so links
are neither lost nor counted twice, and no list of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, saved, with_rows
from .graph import components
from .runs import whole_runs

#: Tables, projections in each, and the width of a cell: vectors of cosine 0.93 miss each other about 15 times in 100,000, closer ones
#: less; vectors at right angles share a cell of a table 4 times in 100,000.
TABLES, PROJECTIONS, WIDTH = 80, 14, 2.0
#: Rows of a bucket that one task compares at once; larger buckets are cut into blocks, each pair of which is a task's.
BLOCK = 1024
#: Rows up to which a bucket is compared together with its neighbours.
SMALL = 32
#: A list of buckets up to this long is sent to all tasks; a longer one is joined by shuffle.
BROADCAST_BUCKETS = 50_000


def cells(x: np.ndarray) -> np.ndarray:
    """(rows, TABLES) bucket hashes of normalised vectors, the same for a dimension wherever they are computed."""
    rng = np.random.default_rng([11, x.shape[1]])
    a, b = rng.normal(size=(x.shape[1], TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), TABLES, PROJECTIONS)
    out = np.broadcast_to(np.arange(TABLES, dtype=np.uint64) + np.uint64(x.shape[1] << 8), cell.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(PROJECTIONS):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, i])
    return out.view(np.int64)


def hashed(vectors: DataFrame) -> DataFrame:
    """(id, label, copies, vector, cells) from (id, label, copies, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.diff(offsets)
            keys = np.zeros((batch.num_rows, TABLES), np.int64)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = flat[offsets[at][:, None] + np.arange(d)]
                keys[at] = cells(x / np.linalg.norm(x, axis=1, keepdims=True))
            table = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * TABLES, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, table], ["id", "label", "copies", "vector", "cells"])

    kind = vectors.schema["label"].dataType.simpleString()
    inner = vectors.schema["vector"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id bigint, label {kind}, copies bigint, vector {inner}, cells array<bigint>")


def _compared(members: DataFrame, least: float) -> DataFrame:
    """(id, links, root) from rows of (key, i, j, side, t, id, copies, vector, cells), cells those of the tables before t, sorted by key, i and j: links found in this bucket, and the least id of its part."""

    def first_seen(cells, p: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows have no table before theirs in common."""
        offsets, flat = cells
        out = np.ones(len(p), bool)
        for n in np.unique(t[t > 0]):
            at = np.flatnonzero(t == n)
            out[at] = ~(flat[offsets[p[at]][:, None] + np.arange(n)] == flat[offsets[q[at]][:, None] + np.arange(n)]).any(1)
        return out

    def linked(ids: np.ndarray, copies: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        links = np.bincount(p, copies[q], n).astype(np.int64) + np.bincount(q, copies[p], n).astype(np.int64)
        root = ids.copy()
        while True:
            low = np.minimum(root[p], root[q])
            after = root.copy()
            np.minimum.at(after, p, low)
            np.minimum.at(after, q, low)
            if (after == root).all():
                break
            root = after
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], ["id", "links", "root"])

    def lists_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        lists = column.combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = np.asarray(lists.offsets).astype(np.int64)
        return offsets - offsets[0], np.asarray(lists.flatten())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, starts, sizes in whole_runs(batches, ["key", "i", "j"]):
            ids, copies, t, side = (g.column(c).to_numpy() for c in ("id", "copies", "t", "side"))
            cross = g.column("i").to_numpy()[starts] != g.column("j").to_numpy()[starts]
            offsets, flat = lists_of(g.column("vector"))
            cells, length = lists_of(g.column("cells")), np.diff(offsets)
            few = (sizes > 1) & (sizes <= SMALL) & ~cross
            # All small buckets at once: each row with the one that follows it at every distance.
            size, place = np.repeat(np.where(few, sizes, 1), sizes), np.arange(len(ids)) - np.repeat(starts, sizes)
            for d in np.unique(length[size > 1]):
                rows = np.flatnonzero((size > 1) & (length == d))
                x = flat[offsets[rows][:, None] + np.arange(d)].astype(np.float64)
                norm, left = np.linalg.norm(x, axis=1), size[rows] - place[rows]
                pairs = []
                for step in range(1, int(size[rows].max())):
                    p = np.flatnonzero(left > step)
                    cos = np.einsum("ij,ij->i", x[p], x[p + step]) / norm[p] / norm[p + step]
                    p = p[cos >= least]
                    pairs.append((p, p + step))
                p, q = (np.concatenate(y) for y in zip(*pairs, strict=True))
                new = first_seen(cells, rows[p], rows[q], t[rows[p]])
                if new.any():
                    yield from linked(ids[rows], copies[rows], p[new], q[new])
            for at, n, crossed in zip(starts[(sizes > 1) & ~few], sizes[(sizes > 1) & ~few], cross[(sizes > 1) & ~few], strict=True):
                x = flat[offsets[at] : offsets[at + n]].astype(np.float64).reshape(n, -1)
                norm = np.linalg.norm(x, axis=1)
                left, right = (np.flatnonzero(side[at : at + n] == 0), np.flatnonzero(side[at : at + n] == 1)) if crossed else (np.arange(n), np.arange(n))
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for begin in range(0, len(left), 512):
                    rows = left[begin : begin + 512]
                    hit = (x[rows] @ x[right].T) / norm[rows][:, None] / norm[right] >= least
                    if not crossed:
                        hit &= right > rows[:, None]
                    p, q = np.nonzero(hit)
                    p, q = rows[p], right[q]
                    new = first_seen(cells, p + at, q + at, np.full(len(p), t[at]))
                    found.append((p[new], q[new]))
                p, q = (np.concatenate(y) for y in zip(*found, strict=True))
                if len(p):
                    yield from linked(ids[at : at + n], copies[at : at + n], p, q)

    return members.mapInArrow(run, "id bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of each row: how many other rows of the same label have a cosine of `least` or more with it.

    Cosines are computed in double precision from the whole vectors. Rows with a null label, and vectors that are null, empty, zero
    or hold null or non-finite components link with nothing; vectors of different lengths are never linked. Rows with
    equal ids are rows of their own; null ids come last. Equal vectors of one label are one node with a number of copies, so a group of copies costs as much as one. A
    component is all that links reach, kept marks its smallest id. Other columns are not read.
    """
    vectors, key_col = with_rows(vectors.select(id_col, vector_col, label_col), id_col)
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.col(label_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), v.alias("vector"), F.coalesce(usable, F.lit(False)).alias("usable"))
    good = rows.where("usable").drop("usable")
    nodes = saved(good.groupBy("label", "vector").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "vector-nodes")
    table = saved(hashed(nodes.select(F.col("node").alias("id"), "label", "copies", "vector")), "vector-cells")
    # Only keys and ids are dealt by bucket; vectors follow to buckets with more than one of them.
    keys = table.select("id", F.posexplode("cells").alias("t", "cell"), "label").select(F.xxhash64("t", "cell", "label").alias("key"), "t", "id")
    shared = saved(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "vector-buckets")
    met = saved(keys.join(F.broadcast(shared) if shared.count() <= BROADCAST_BUCKETS else shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "vectors-met")
    spread = met.join(table.select("id", "copies", "vector", "cells"), "id").withColumn("cells", F.slice("cells", 1, F.col("t")))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # Each block meets itself and every other one: i <= j, side 0 the rows of block i, side 1 those of block j.
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"), (F.col("block") > o).cast("int").alias("side")))
    members = spread.withColumn("block", block).withColumn("m", F.explode(meetings)).select("key", "m.i", "m.j", "m.side", "t", "id", "copies", "vector", "cells")
    found = saved(_compared(members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), least), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    node = nodes.join(links.withColumnRenamed("id", "node"), "node", "left").join(parts.withColumnRenamed("id", "node"), "node", "left")
    node = saved(node.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "vector-results")
    out = good.join(node, ["label", "vector"]).select("id", "n_links", "component_id").unionByName(rows.where("not usable").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    out = out.select("id", F.col("n_links").cast("bigint").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    if key_col == id_col:
        return out.withColumnRenamed("id", id_col)
    names = vectors.select(F.col(key_col).alias("id"), F.col(id_col).alias("name"))
    out = out.join(names, "id").join(names.select(F.col("id").alias("component_id"), F.col("name").alias("component_name")), "component_id")
    return out.select(F.col("name").alias(id_col), "n_links", F.col("component_name").alias("component_id"), "kept")
