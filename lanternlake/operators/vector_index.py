"""A stored index of vectors: inverted lists around centroids, searched by probes, exactly if asked for.

Centroids come from a bounded sample; every vector is put in the list of the centroid that it is nearest to by angle. A search takes a
query's lists in order of the centroids' angles and compares it with the vectors of the first few; how many is measured on the sample when the index is
built, so that a share `target` of the nearest is found there. An exact search goes on to each list that can still hold something: a
list's radius is the largest angle of its vectors, so none of them is nearer to a query than the centroid's angle less the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlake.operators.retrieval import CANDIDATES, ranked
from lanternlake.storage import checkpointed, stored

#: Vectors that the centroids are fitted on and probes are measured with, the ones with the least hashes of their ids; of these so many ask.
SAMPLE, ASKING = 20_000, 300
#: The list of vectors that have no angle (null, zero, not finite, of another length); each search reads it.
ODD = -1

LISTS = "chunk_id bigint, project_id string, vector array<double>, angle double, list int"
CENTROIDS = "list int, centroid array<double>, radius double, probes int"


@dataclass(frozen=True)
class Index:
    """centroids: unit vectors, a row each. radii: the largest angle in each list. probes: lists that a search reads unless told otherwise."""

    path: str
    centroids: np.ndarray
    radii: np.ndarray
    probes: int


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column scaled to length one, zeros for odd ones, and which are not odd."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        v = np.array(v.values.to_numpy(zero_copy_only=False), float) if v.is_valid else np.zeros(0)
        if len(v) == width:
            out[i] = v
    with np.errstate(invalid="ignore", over="ignore"):
        length = np.linalg.norm(out, axis=1)
    good = np.isfinite(length) & (length > 0)
    out[~good] = 0
    out[good] /= length[good, None]
    return out, good


def fitted(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means; an empty one moves to the vector that is farthest from its own."""
    rng = np.random.default_rng(11)
    centres = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = sample @ centres.T
        own, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """The fewest lists with which, within the sample, a share `target` of its vectors' k nearest is found. More vectors are nearer to each other, so whole tables do better."""
    asking = sample[:: max(1, len(sample) // ASKING)]
    nearest = np.argsort(-(asking @ sample.T), axis=1)[:, : min(k, len(sample))]
    own = (sample @ centres.T).argmax(1)
    turn = np.argsort(np.argsort(-(asking @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(turn, own[nearest], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, target: float = 0.95, k: int = CANDIDATES) -> Index:
    """The index of vectors (chunk_id, project_id, vector), written under path by list; each vector is in one.

    lists: how many centroids, the square root of the sample's size unless given. The sample's vectors, of the most frequent length in it, are fitted on the
    driver; all others are only met in the tasks. Repeated ids are rows of their own. Without a usable vector there is no list but the odd one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("project_id").cast("string").alias("project_id"), F.col("vector").cast("array<double>").alias("vector"))
    picked = rows.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    widths = pc.list_value_length(picked)
    width = int(np.bincount(widths.to_numpy(zero_copy_only=False)).argmax()) if len(picked) else 0
    known, good = unit_rows(picked.filter(pc.equal(widths, width)), width)
    known = known[good]
    centres = fitted(known, min(len(known), lists or max(1, round(len(known) ** 0.5)))) if len(known) else np.zeros((0, width))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, fine = unit_rows(batch.column(2), width)
            near = unit @ centres.T if len(centres) else np.zeros((len(unit), 1))
            own = np.where(fine & (len(centres) > 0), near.argmax(1), ODD)
            angle = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(own.astype(np.int32))], ["chunk_id", "project_id", "vector", "angle", "list"])

    stored(rows.mapInArrow(assigned, LISTS), f"{path}/lists", "list")
    radii = np.zeros(len(centres))
    # A row a list.
    for r in spark.read.schema(LISTS).parquet(f"{path}/lists").where(F.col("list") >= 0).groupBy("list").agg(F.max("angle").alias("radius")).collect():
        radii[r["list"]] = r["radius"]
    probes = probes_needed(known, centres, k, target) if len(known) else 0
    out = Index(path, centres, radii, probes)
    stored(spark.createDataFrame([(i, c.tolist(), float(radii[i]), probes) for i, c in enumerate(centres)], CENTROIDS), f"{path}/centroids")
    return out


def opened(spark: SparkSession, path: str) -> Index:
    """The index under path."""
    rows = spark.read.schema(CENTROIDS).parquet(f"{path}/centroids").orderBy("list").collect()
    return Index(path, np.array([r["centroid"] for r in rows]), np.array([r["radius"] for r in rows]), rows[0]["probes"] if rows else 0)


def _turns(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, project_id, q, list, turn, bound): each query's lists in order of the centroids' angles, and the largest cosine that each can hold."""
    centres, radii = index.centroids, index.radii
    width = centres.shape[1] if len(centres) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, _ = unit_rows(batch.column(2), width)
            angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
            order = np.argsort(angle, axis=1, kind="stable")
            turn = np.empty_like(order)
            np.put_along_axis(turn, order, np.arange(len(centres))[None, :].repeat(len(order), 0), 1)
            bound = np.cos(np.maximum(angle - radii, 0))
            n, m = len(unit), len(centres) + 1
            # The odd list comes first for all.
            columns = [np.c_[np.full(n, ODD), np.tile(np.arange(len(centres)), (n, 1))].ravel().astype(np.int32), np.c_[np.full(n, -1), turn].ravel().astype(np.int32), np.c_[np.ones(n), bound].ravel()]
            who = batch.take(pa.array(np.repeat(np.arange(n), m)))
            yield pa.RecordBatch.from_arrays([*who.columns, *map(pa.array, columns)], ["query_id", "project_id", "q", "list", "turn", "bound"])

    asked = queries.where("vector is not null").select("query_id", "project_id", F.col("vector").cast("array<double>").alias("q"))
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    return asked.mapInArrow(run, f"query_id {kinds['query_id']}, project_id {kinds['project_id']}, q array<double>, list int, turn int, bound double")


#: Vectors and queries that are compared in one block: a matrix of their cosines is all that a task holds.
BLOCK, ASKED = 8192, 1024


def _plain(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column by width: their places and values. Null vectors and those with a null are left out."""
    by: dict[int, list] = {}
    for i, v in enumerate(column):
        if v.is_valid and not v.values.null_count:
            by.setdefault(len(v), []).append((i, v.values.to_numpy(zero_copy_only=False)))
    return {w: (np.array([i for i, _ in rows]), np.array([x for _, x in rows], float).reshape(len(rows), w)) for w, rows in by.items()}


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up in order as functions.vector does, so that the last bit is the same."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _compared(k: int):
    """What a block does: of its vectors, each query's k nearest and all that tie with the k-th when rounded, with their cosines."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asking, raw = [], [], []
        known = _plain(vectors.column("vector").combine_chunks())
        with np.errstate(all="ignore"):
            for width, (at, q) in _plain(queries.column("q").combine_chunks()).items():
                if width not in known:
                    continue
                place, v = known[width]
                near = (q @ v.T) / (np.sqrt(_dot(q, q))[:, None] * np.sqrt(_dot(v, v))[None, :])
                # A product of matrices is off by less than this; what is not a number stays in.
                low = np.full(len(q), -np.inf) if len(v) <= k else -np.partition(-np.where(np.isnan(near), -np.inf, near), k - 1, axis=1)[:, k - 1] - 2e-6
                i, j = np.nonzero(~(near < low[:, None]))
                length = np.sqrt(_dot(v, v))[j] * np.sqrt(_dot(q, q))[i]
                good = length != 0
                ids.append(place[j][good])
                asking.append(at[i][good])
                raw.append((_dot(v[j], q[i]) / length)[good])
        take = lambda t, c, parts: t.column(c).combine_chunks().take(pa.array(np.concatenate(parts) if parts else np.zeros(0, int)))
        return pa.table([take(queries, "query_id", asking), take(vectors, "chunk_id", ids), pa.array(np.concatenate(raw) if raw else np.zeros(0))], ["query_id", "chunk_id", "raw"])

    return run


def met(queries: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query_id, chunk_id, raw): cosines to six places of queries (query_id, q, keys) with vectors (chunk_id, vector, keys) of equal keys; of each block at least the k nearest of each query.

    Each block of a key's vectors meets each block of its queries, whole matrices at a time; blocks are dealt by hashes.
    """
    most = lambda d: d.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    many, asked = -(-most(rows) // BLOCK), -(-most(queries) // ASKED)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(*keys, "chunk_id", F.col("vector").cast("array<double>").alias("vector"), part("chunk_id", many).alias("v"), every(asked).alias("w"))
    right = queries.select(*keys, "query_id", F.col("q").cast("array<double>").alias("q"), part("query_id", asked).alias("w"), every(many).alias("v"))
    kinds = dict(left.dtypes) | dict(right.dtypes)
    by = [*keys, "v", "w"]
    out = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_compared(k), f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, raw double")
    return out.select("query_id", "chunk_id", F.round("raw", 6).alias("raw"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, rank, score) as retrieval.vector_topk() of queries and vectors (chunk_id, project_id, vector), by blocks: all pairs are compared."""
    found = met(queries.where("vector is not null").select("query_id", "project_id", F.col("vector").alias("q")), vectors, ["project_id"], k)
    return ranked(found, k, F.desc("raw"), "chunk_id").select("query_id", "chunk_id", "rank", F.greatest(F.lit(0.0), "raw").alias("score"))


def _met(turns: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, chunk_id, raw): met() of queries with the vectors of their project in their lists."""
    rows = turns.sparkSession.read.schema(LISTS).parquet(f"{index.path}/lists").select("list", "project_id", "chunk_id", "vector")
    return met(turns.select("query_id", "project_id", "q", "list"), rows, ["list", "project_id"], k)


def topk(queries: DataFrame, index: Index, k: int = CANDIDATES, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, chunk_id, rank, score) as retrieval.vector_topk() of queries (query_id, project_id, vector), from the lists.

    Compares with the vectors of the first `probes` lists, as many as the index was built for unless given. exact: and with those of all lists that can hold
    one as near as the k-th found so far, so that ranks and scores are those of a full comparison.
    """
    turns = checkpointed(_turns(queries, index))
    first = F.col("turn") < (index.probes if probes is None else probes)
    order = F.desc("raw"), "chunk_id"
    found = ranked(_met(turns.where(first), index, k), k, *order)
    if exact:
        found = checkpointed(found)
        least = found.where(F.col("rank") == k).select(F.col("query_id").alias("query"), F.col("raw").alias("least"))
        # Rounding to six places may bring a vector up to the k-th.
        rest = turns.where(~first).join(least, F.col("query_id") == F.col("query"), "left").where("least is null or bound >= least - 0.000002")
        found = ranked(found.drop("rank").unionByName(_met(rest.select(turns.columns), index, k)), k, *order)
    return found.select("query_id", "chunk_id", "rank", F.greatest(F.lit(0.0), "raw").alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, n_exact, n_found, recall): for each query, how many of its exact hits (query_id, chunk_id) were found."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_exact"), 6))
