"""Ranked retrieval for many queries at once: queries are rows, a top-k is a window limited by query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanternlake.functions.text import counted, tokens
from lanternlake.functions.vector import dot, norm
from lanternlake.storage import checkpointed

CANDIDATES, TOP_K, RRF_K = 50, 10, 60
#: The limit of the sum of 1/j**2, by which a term's repetitions are normalised (fixed value).
_ZETA_2 = 1.64493406685
#: Rows and bytes (as JSON) of a query set that may be sent to all tasks; larger sets are joined by shuffle.
BROADCAST_QUERIES, BROADCAST_BYTES = 20_000, 64 << 20


def is_small(queries: DataFrame) -> bool:
    """Whether a query set may be sent to all tasks, by its rows and bytes."""
    size = queries.limit(BROADCAST_QUERIES + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return size["n"] <= BROADCAST_QUERIES and (size["b"] or 0) <= BROADCAST_BYTES


def small(queries: DataFrame) -> DataFrame:
    """The query set, with a broadcast hint if it is checked to be small."""
    return F.broadcast(queries) if is_small(queries) else queries


#: Parts into which each project's chunks are dealt for query sets that are joined by shuffle: projects are few and of any size.
PARTS = 64


def in_project(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Each of chunks (project_id, chunk_id, ...) with each query (project_id, ...) of its project."""
    if is_small(queries):
        return chunks.join(F.broadcast(queries), "project_id")
    parted = chunks.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)).cast("int"))
    return parted.join(queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["project_id", "part"]).drop("part")


def ranked(scored: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query with their rank. Each task cuts to k before anything is shuffled."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def filtered(chunks: DataFrame, document_types: list[str] | None = None, **equal: str | None) -> DataFrame:
    """chunks of some types and with the given service, language or environment; what isn't given doesn't filter."""
    if document_types:
        chunks = chunks.where(F.col("document_type").isin(document_types))
    for name, value in equal.items():
        if value is not None:
            chunks = chunks.where(F.col(name) == value)
    return chunks


def vector_topk(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = CANDIDATES, version: str | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, score): the k nearest chunks of each query (query_id, project_id, vector) in its project.

    Ranks by the cosine to six places, then id; the score is not below 0. Chunks without a vector, or one of another version, don't appear.
    """
    if version is not None:
        vectors = vectors.where(F.col("model_version") == version)
    # Doubles and lengths are made once a vector, not once a pair.
    made = lambda v, name, length: (F.col(v).cast("array<double>").alias(name), norm(F.col(v)).alias(length))
    candidates = chunks.select("chunk_id", "project_id").join(vectors.select("chunk_id", *made("vector", "vector", "nv")), "chunk_id")
    # A query without a vector finds nothing: it is left out before it meets all of its project.
    pairs = in_project(candidates, queries.where("vector is not null").select("query_id", "project_id", *made("vector", "q", "nq")))
    scored = pairs.select("query_id", "chunk_id", F.round(dot(F.col("vector"), F.col("q")) / F.nullif(F.col("nv") * F.col("nq"), F.lit(0.0)), 6).alias("raw")).where("raw is not null")
    return ranked(scored, k, F.desc("raw"), "chunk_id").select("query_id", "chunk_id", "rank", F.greatest(F.lit(0.0), "raw").alias("score"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, project_id, term, n_terms): distinct terms of each query's text."""
    terms = F.array_distinct(tokens(F.col("text")))
    return queries.select("query_id", "project_id", terms.alias("terms")).select("query_id", "project_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def term_weight(tf: Column) -> Column:
    """What a term counts that stands n times: 0.1 * (1 + 1/4 + ... + 1/n**2) over the limit of that sum."""
    return F.lit(0.1) * F.aggregate(F.sequence(F.lit(1), tf), F.lit(0.0), lambda a, j: a + F.lit(1.0) / (j * j)) / F.lit(_ZETA_2)


def term_score(hits: DataFrame, weight: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score) from (query_id, chunk_id, term, n_terms, tf): the sum of the terms' weights, term_weight() if none is given, over the number of the query's terms."""
    each = term_weight(F.col("tf")) if weight is None else weight
    return hits.groupBy("query_id", "chunk_id", "n_terms").agg(F.sum(each).alias("s")).select("query_id", "chunk_id", F.round(F.col("s") / F.col("n_terms"), 6).alias("score"))


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, rank, score): the k chunks of a query's project that share most with its terms, one term at least.

    A term that a chunk has n times counts 0.1 * (1 + 1/4 + ... + 1/n**2), over the limit of that sum; the score is the mean over the query's terms.
    """
    # times: above 1 only if a query id stands in several rows.
    asked = checkpointed(query_terms(queries).groupBy("query_id", "project_id", "term", "n_terms").agg(F.count("*").cast("int").alias("times")))
    near = F.broadcast if is_small(asked) else lambda df: df
    # Words are counted within their chunk and meet the terms before the queries that ask for them: only a chunk's different hits are shuffled, once, by chunk.
    words = chunks.select("project_id", "chunk_id", F.explode(counted(tokens(F.col("content")))).alias("w")).select("project_id", "chunk_id", "w.term", "w.tf")
    hits = words.join(near(asked.select("project_id", "term").distinct()), ["project_id", "term"], "left_semi")
    tf = hits.repartition("chunk_id").groupBy("project_id", "chunk_id", "term").agg(F.sum("tf").cast("int").alias("tf"))
    each = tf.select("*", term_weight(F.col("tf")).alias("weight")).join(near(asked), ["project_id", "term"])
    weight = F.when(F.col("times") == 1, F.col("weight")).otherwise(term_weight(F.col("tf") * F.col("times")))
    return ranked(term_score(each, weight), k, F.desc("score"), "chunk_id").select("query_id", "chunk_id", "rank", "score")


def keyword_matches(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of all chunks that have a term of the query."""
    words = chunks.select("project_id", "chunk_id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"))
    return words.join(small(query_terms(queries)), ["project_id", "term"]).select("query_id", "chunk_id").distinct()


def dependency_leg(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, rank, score): chunks whose path, symbol or service is one of the query's (query_id, project_id, paths, symbols, services).

    By id, k at most; score 1/rank. Blank terms are dropped; no other filter applies.
    """
    terms = lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), lambda x: x)
    legs = []
    for kind, column in (("paths", "path"), ("symbols", "symbol"), ("services", "service")):
        if column in chunks.columns and kind in queries.columns:
            wanted = queries.select("query_id", "project_id", F.explode(terms(F.col(kind))).alias("term")).distinct()
            legs.append(chunks.select("project_id", "chunk_id", F.col(column).alias("term")).join(small(wanted), ["project_id", "term"]).select("query_id", "chunk_id"))
    hits = legs[0]
    for leg in legs[1:]:
        hits = hits.unionByName(leg)
    return ranked(hits.distinct(), k, "chunk_id").withColumn("score", F.lit(1.0) / F.col("rank"))


def rrf_fuse(legs: DataFrame, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """(query_id, item_id, rank, score) from (query_id, leg, item_id, rank): the sum over legs of 1/(k + rank), to six places."""
    if k < 1:
        raise ValueError("k must be at least 1")
    fused = legs.groupBy("query_id", "item_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    out = fused.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.where(F.col("rank") <= top)


STRATEGIES = ("hybrid", "vector", "keyword", "dependency")


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, strategy: str = "hybrid", top: int = TOP_K, version: str | None = None, alike: bool = False) -> DataFrame:
    """(query_id, rank, chunk_id, score, vector, keyword, dependency) for queries (query_id, project_id, text, vector and, if any, paths, symbols, services).

    vector is the cosine, the others are ranks; each is null where its leg didn't find the chunk or isn't part of the strategy. alike: see leg_hits().
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    legs = [leg for leg in ("vector", "keyword") if strategy in ("hybrid", leg)] + ["dependency"] * bool(TERMS & set(queries.columns))
    if not legs:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, chunk_id bigint, score double, vector double, keyword int, dependency int")
    return fused(leg_hits(queries, chunks, vectors, legs, version, alike), strategy, top)


#: Columns of a query that the dependency leg looks for.
TERMS = {"paths", "symbols", "services"}


def asked_once(queries: DataFrame, columns: list[str], leg) -> DataFrame:
    """The rows of a leg for queries (query_id, ...), a function of queries, where those that are equal in the columns are searched once."""
    keyed = queries.withColumn("same", F.sha2(F.to_json(F.struct(*columns)), 256))
    firsts = keyed.groupBy("same").agg(F.min("query_id").alias("first"))
    whose = checkpointed(keyed.select("query_id", "same").join(firsts, "same").select("query_id", "first"))
    found = leg(checkpointed(queries.join(whose.where("query_id = first").select("query_id"), "query_id", "left_semi")))
    return whose.join(found.withColumnRenamed("query_id", "first"), "first").drop("first")


def leg_hits(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, legs: list[str], version: str | None = None, alike: bool = False) -> DataFrame:
    """(query_id, chunk_id, rank, score, leg): the candidates of each leg. alike: many queries are equal in what a leg looks at, which is then searched once."""
    reads = {"vector": ["project_id", "vector"], "keyword": ["project_id", "text"], "dependency": ["project_id", *sorted(TERMS & set(queries.columns))]}
    made = {"vector": lambda q: vector_topk(q, chunks, vectors, version=version), "keyword": lambda q: keyword_topk(q, chunks), "dependency": lambda q: dependency_leg(q, chunks)}
    found = {leg: asked_once(queries, reads[leg], made[leg]) if alike else made[leg](queries) for leg in legs}
    return reduce(DataFrame.unionByName, [rows.withColumn("leg", F.lit(leg)) for leg, rows in found.items()])


def fused(hits: DataFrame, strategy: str, top: int = TOP_K) -> DataFrame:
    """(query_id, rank, chunk_id, score, vector, keyword, dependency) from rows of leg_hits(), by one leg's scores or the sum of 1/(k + rank) over all."""
    of = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    score = F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))) if strategy == "hybrid" else of(strategy, "score")
    both = hits.groupBy("query_id", "chunk_id").agg(F.round(score, 6).alias("score"), F.round(of("vector", "score"), 6).alias("vector"), of("keyword", "rank").alias("keyword"), of("dependency", "rank").alias("dependency"))
    return ranked(both.where("score is not null"), top, F.desc("score"), "chunk_id").select("query_id", "rank", "chunk_id", "score", "vector", "keyword", "dependency")


def hydrate(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """found with the chunks' columns, joined after the cut: content moves only for what is returned. found is computed once."""
    found = checkpointed(found)
    return chunks.join(small(found), "chunk_id").select(*found.columns, *(c for c in chunks.columns if c not in found.columns))


def merge_queries(found: DataFrame, top: int) -> DataFrame:
    """(request_id, rank, ...) from results with request_id, query_ord and rank: queries in order, a chunk's first hit wins, top rows stay."""
    first = Window.partitionBy("request_id", "chunk_id").orderBy("query_ord", "rank")
    kept = found.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    order = Window.partitionBy("request_id").orderBy("query_ord", "rank")
    return kept.withColumn("merged_rank", F.row_number().over(order)).where(F.col("merged_rank") <= top)
