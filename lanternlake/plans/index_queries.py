"""Queries of the stored indexes of terms and vectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternlake.operators import postings as T
from lanternlake.operators import vector_index as W
from lanternlake.plans.retrieval_queries import DOCS, KEYWORD_SQL, VECS, WITH, _cos, _tokens, query_set, vector_sql
from lanternlake.sources import tables as S
from lanternlake.storage import new_folder


def grown_index(spark, sf) -> str:
    """The path of an index that came to the documents by three ingestions: first without a third of them, some with another text or
    project and some that go again; then the missing ones; then what changed and what went.
    """
    now = S.documents(spark, sf).select("chunk_id", "project_id", "content")
    n, path = F.col("chunk_id"), new_folder(spark, "postings")
    changed = (n % 3 == 1) | (n % 11 == 0)
    before = now.select("chunk_id", F.when(n % 11 == 0, "other").otherwise(F.col("project_id")).alias("project_id"), F.when(n % 3 == 1, F.concat("content", F.lit(" earlier words"))).otherwise(F.col("content")).alias("content"))
    passing = now.where(n % 7 == 0).select((-1 - n).alias("chunk_id"), "project_id", "content")
    T.apply_delta(path, None, before.where(n % 3 != 0).unionByName(passing))
    T.apply_delta(path, None, now.where(n % 3 == 0))
    T.apply_delta(path, before.where((n % 3 != 0) & changed).unionByName(passing), now.where((n % 3 != 0) & changed))
    return path


def postings_topk(spark, sf):
    return T.keyword_topk(query_set(spark, sf), grown_index(spark, sf))


def postings_frequencies(spark, sf):
    return T.live_frequencies(spark, grown_index(spark, sf))


def postings_matches(spark, sf):
    """From the compacted index."""
    to = new_folder(spark, "postings")
    T.compacted(spark, grown_index(spark, sf), to)
    return T.keyword_matches(query_set(spark, sf), to).groupBy("query_id").agg(F.count("*").alias("n_matches"))


def _by_project(spark, sf):
    return S.vectors(spark, sf).join(S.documents(spark, sf).select("chunk_id", "project_id"), "chunk_id").select("chunk_id", "project_id", "vector")


def vector_index_topk(spark, sf):
    """All benchmark items in their projects, exactly."""
    return W.topk(query_set(spark, sf), W.build(_by_project(spark, sf), new_folder(spark, "vectors")), exact=True)


def _asking(spark, sf):
    """Each vector whose id divides by 20, of all vectors as one project."""
    every = S.vectors(spark, sf).select("chunk_id", F.lit("all").alias("project_id"), "vector")
    return every, every.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "project_id", "vector")


def vector_index_recall(spark, sf):
    """The share of the exact ten nearest that the probes alone find."""
    every, asked = _asking(spark, sf)
    index = W.build(every, new_folder(spark, "vectors"), k=10)
    return W.recall(W.topk(asked, index, 10), W.nearest(asked, every, 10))


QUERIES = {f.__name__: f for f in (postings_topk, postings_frequencies, postings_matches, vector_index_topk, vector_index_recall)}

SQL = {
    "postings_topk": f"{WITH}, {KEYWORD_SQL} SELECT * FROM kleg",
    "postings_frequencies": f"WITH {DOCS} SELECT project_id, term, count(*) AS df FROM (SELECT project_id, chunk_id, unnest(list_distinct({_tokens('content')})) AS term FROM docs) GROUP BY ALL",
    "postings_matches": f"{WITH}, {KEYWORD_SQL} SELECT query_id, count(DISTINCT chunk_id) AS n_matches FROM tf GROUP BY 1",
    "vector_index_topk": f"{WITH}, {vector_sql()} SELECT * FROM vleg",
}
