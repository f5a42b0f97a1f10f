"""Stored indexes: what deltas leave equals a rebuild, reruns leave the same, searches equal the full comparison."""

from __future__ import annotations

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternlake.operators import postings as T
from lanternlake.operators import retrieval as R
from lanternlake.operators import vector_index as W
from lanternlake.plans import index_queries as Q
from lanternlake.storage import stored

CHUNKS = "chunk_id bigint, project_id string, content string"


def folder() -> str:
    return tempfile.mkdtemp(prefix="spark-") + "/index"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_deltas_equal_a_rebuild_and_run_again_leave_the_same(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["ash", "Ash", "elm", "fir", "oak", "a", "yew_1", "härte"]) for _ in range(rng.randrange(12)))
    now, path = {}, folder()
    for step in range(5):
        old = {k: now[k] for k in rng.sample(sorted(now), len(now) // 3)} if now else {}
        gone = [k for k in old if rng.random() < 0.3]
        new = {k: (rng.choice("pq"), text()) for k in old if k not in gone} | {100 * step + i: (rng.choice("pq"), None if i == 3 else text()) for i in range(10)}
        as_rows = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], CHUNKS)
        number = T.apply_delta(path, as_rows(old) if old else None, as_rows(new))
        if step % 2:
            assert T.apply_delta(path, as_rows(old), as_rows(new), number) == number == step
        now = {k: v for k, v in now.items() if k not in old} | new
    chunks = spark.createDataFrame([(k, *v) for k, v in now.items()], CHUNKS)
    found = ("project_id", "term", "chunk_id", "tf")
    assert rows(T.live_postings(spark, path), *found) == rows(T.postings(chunks), *found)
    assert rows(T.live_frequencies(spark, path), "project_id", "term", "df") == rows(T.frequencies(T.postings(chunks)), "project_id", "term", "df")
    queries = spark.createDataFrame([(1, "p", "Ash härte"), (2, "q", "oak elm elm nothing"), (3, "q", ""), (4, "none", "ash")], "query_id int, project_id string, text string")
    hits = ("query_id", "chunk_id", "rank", "score")
    assert rows(T.keyword_topk(queries, path, 7), *hits) == rows(R.keyword_topk(queries, chunks, 7), *hits)
    to = folder()
    T.compacted(spark, path, to)
    assert rows(T.live_postings(spark, to), *found) == rows(T.postings(chunks), *found)
    assert rows(T.keyword_matches(queries, to), "query_id", "chunk_id") == rows(R.keyword_matches(queries, chunks), "query_id", "chunk_id")


def test_words_are_counted_without_a_shuffle(spark):
    chunks = spark.createDataFrame([(1, "p", "ash Elm ash fir_1 ASH elm"), (2, None, "ash"), (3, "p", ""), (4, "q", None), (5, "q", "İx ßß é́e x ́a")], CHUNKS)
    found = T.postings(chunks)
    assert rows(found.where("chunk_id < 5"), "project_id", "term", "chunk_id", "tf") == rows(spark.createDataFrame([("p", "ash", 1, 3), ("p", "elm", 1, 2), ("p", "fir_1", 1, 1), (None, "ash", 2, 1)], "project_id string, term string, chunk_id bigint, tf int"), "project_id", "term", "chunk_id", "tf")
    plain = F.split(F.lower(F.coalesce("content", F.lit(""))), r"(?U)[^\w]+")
    expected = chunks.select("chunk_id", F.explode(F.filter(plain, lambda x: F.length(x) >= 2)).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").cast("int").alias("tf"))
    assert rows(found, "chunk_id", "term", "tf") == rows(expected, "chunk_id", "term", "tf")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_generation_run_again_with_less_leaves_no_bucket_of_before(spark):
    path = folder()
    T.apply_delta(path, None, spark.createDataFrame([(k, "p", f"word{k}") for k in range(50)], CHUNKS), 0)
    T.apply_delta(path, None, spark.createDataFrame([(1, "p", "word1")], CHUNKS), 0)
    assert rows(T.live_postings(spark, path), "term") == [("word1",)]


def test_a_generation_without_its_commit_is_not_seen(spark):
    path = folder()
    T.apply_delta(path, None, spark.createDataFrame([(1, "p", "kept")], CHUNKS))
    half = T.postings(spark.createDataFrame([(2, "p", "half")], CHUNKS)).withColumn("bucket", F.lit(0)).withColumn("generation", F.lit(1))
    stored(half, f"{path}/postings", "generation", "bucket")
    assert rows(T.live_postings(spark, path), "term") == [("kept",)] and T.last_generation(spark, path) == 0


def test_an_empty_index(spark):
    path = folder()
    assert T.live_postings(spark, path).collect() == [] and T.live_frequencies(spark, path).collect() == []
    T.apply_delta(path, None, spark.createDataFrame([], CHUNKS))
    queries = spark.createDataFrame([(1, "p", "x y zz")], "query_id int, project_id string, text string")
    assert T.keyword_topk(queries, path).collect() == []


def test_only_buckets_of_the_terms_are_read(spark):
    path = folder()
    T.apply_delta(path, None, spark.createDataFrame([(k, "p", f"word{k} other{k}") for k in range(300)], CHUNKS))
    terms = R.query_terms(spark.createDataFrame([(1, "p", "word7")], "query_id int, project_id string, text string"))
    assert 0 < len(T.live_postings(spark, path, terms).inputFiles()) < 10 < len(T.live_postings(spark, path).inputFiles()) or T.live_postings(spark, path, terms).count() < 60


VECTORS = "chunk_id bigint, project_id string, vector array<double>"


def awkward_vectors(seed: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 12))
    out = [(i, "pq"[i % 2], (centres[i % 8] + rng.normal(size=12) * rng.choice([0.05, 0.4, 2])).tolist()) for i in range(n)]
    return out + [(n + 1, "p", None), (n + 2, "p", [0.0] * 12), (n + 3, "p", [1.0, 2.0]), (n + 4, "q", out[0][2]), (n + 5, "q", out[0][2]), (n + 6, "q", [x * 3 for x in out[1][2]]), (n + 7, "p", [])]


@pytest.mark.parametrize("lists", [1, 5, 40, None])
@pytest.mark.parametrize("probes", [0, 1, None])
def test_an_exact_search_equals_the_full_comparison(spark, lists, probes):
    data = awkward_vectors(2, 300)
    vectors = spark.createDataFrame([(*r, "x") for r in data], VECTORS + ", list string")
    index = W.build(vectors, folder(), lists=lists)
    queries = spark.createDataFrame([(i, p, v) for i, p, v in data[::20]] + [(900, "p", None), (901, "none", data[0][2]), (902, "q", [0.0] * 12), (903, "p", [2.0, 4.0])], "query_id bigint, project_id string, vector array<double>")
    hits = ("query_id", "chunk_id", "rank", "score")
    expected = rows(R.vector_topk(queries, vectors, vectors, 9), *hits)
    assert rows(W.topk(queries, index, 9, probes, exact=True), *hits) == expected
    again = W.opened(spark, index.path)
    assert again.probes == index.probes and np.allclose(again.centroids, index.centroids) and rows(W.topk(queries, again, 9, probes, exact=True), *hits) == expected
    assert spark.read.parquet(f"{index.path}/lists").count() == len(data)


def test_an_index_without_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    queries = spark.createDataFrame([(1, "p", [1.0, 0.0])], "query_id bigint, project_id string, vector array<double>")
    assert W.topk(queries, W.build(none, folder()), exact=True).collect() == []


def test_recall_of_the_probes(spark, sf_dir):
    """Every id that divides by 20 against all rows."""
    out = Q.vector_index_recall(spark, sf_dir).collect()
    assert len(out) == 25 and all(r.n_exact == 10 for r in out)
    assert sum(r.recall for r in out) / len(out) >= 0.9


def test_clustered_vectors_need_few_probes(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    data = [(i, "p", (centres[i % 40] + rng.normal(size=16) * 0.1).tolist()) for i in range(2000)]
    vectors = spark.createDataFrame(data, VECTORS)
    index = W.build(vectors, folder(), k=10)
    queries = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    found = W.recall(W.topk(queries, index, 10), R.vector_topk(queries, vectors, vectors, 10)).agg(F.avg("recall")).first()[0]
    assert index.probes <= 4 and found >= 0.9
    # Bounds shut out most lists of an exact search.
    turns = W._turns(queries, index)
    assert turns.where("bound >= 0.9").count() < 0.2 * turns.count()


def test_large_query_sets_are_joined_by_parts(spark, monkeypatch):
    data = awkward_vectors(5, 120)
    vectors = spark.createDataFrame(data, VECTORS)
    queries = spark.createDataFrame([(i, p, v) for i, p, v in data[:30]], "query_id bigint, project_id string, vector array<double>")
    hits = ("query_id", "chunk_id", "rank", "score")
    whole = rows(R.vector_topk(queries, vectors, vectors, 5), *hits)
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 3)
    assert rows(R.vector_topk(queries, vectors, vectors, 5), *hits) == whole


def test_blocks_find_what_all_pairs_find(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 20)
    monkeypatch.setattr(W, "ASKED", 7)
    rng = np.random.default_rng(3)
    rows = [(k, f"p{k % 2}", [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(150)]
    rows += [(200, "p0", None), (201, "p0", [0.0] * 4), (202, "p0", [1.0, None, 0.0, 0.0]), (203, "p0", [1.0, 2.0]), (204, "p1", [float("nan")] * 4), (205, "p1", [float("inf"), 0.0, 0.0, 1.0]), (206, "p0", [])]
    vectors = spark.createDataFrame(rows, "chunk_id bigint, project_id string, vector array<double>")
    asked = vectors.where("chunk_id % 3 = 0 or chunk_id >= 200").withColumnRenamed("chunk_id", "query_id")
    got, want = W.nearest(asked, vectors, 5), R.vector_topk(asked, vectors.select("chunk_id", "project_id"), vectors, 5)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
