"""Compositions: a change as one model, and the evidence that a change or an incident asks for, many of them side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternlake.operators import change as C
from lanternlake.operators import evidence as P
from lanternlake.operators import incidents as N
from lanternlake.operators import retrieval as R
from lanternlake.operators import symbols as M
from lanternlake.storage import checkpointed, dealt, kept

#: Steps within which an action counts as reaching a changed symbol.
API_DEPTH = 5

#: Kinds of rows in a change's model.
SECTIONS = ("added", "removed", "modified", "impacted", "edge", "api", "integration", "service", "file")


def change_model(base: DataFrame, target: DataFrame, edges: DataFrame, contents: DataFrame, depth: int = 2) -> DataFrame:
    """(section, id, detail) of all that a change between two versions of a program means.

    base, target: symbols (symbol_id, kind, name, fqn, signature, parameters, return_type, declaration_hash, project, file_path); edges: of the target.
    added, removed and modified: the changed symbols, a moved signature being one modified symbol. impacted: what depends on them within `depth` steps, with the
    step. edge: edges that touch either, `from -> to`. api: actions that reach a changed symbol, with verb and route. integration: clients that a changed or impacted
    symbol connects to, with the number of these. service: projects, file: files of changed and impacted symbols. Each row once, nulls left out.
    """
    diff = checkpointed(C.changed_symbols(C.reclassify(C.symbol_diff(base, target), base, target)))
    ids = diff.select("symbol_id")
    # The edges are computed and shuffled once for all that follows.
    ways = C.laid_out(edges)
    back = ways.select(F.col("to_id").alias("symbol_id"), F.col("from_id").alias("next_id"))
    impacted = checkpointed(C.reached(ids, back, depth, target.select("symbol_id")).select("symbol_id", "level"))
    touched = kept(dealt(ids.unionByName(impacted.select("symbol_id")), "symbol_id").distinct(), "symbol_id")
    near = C.touching_once(touched, ways).select(F.lit("edge").alias("section"), F.concat("from_id", F.lit(" -> "), "to_id").alias("id"), F.lit(None).cast("string").alias("detail"))
    # Whether an action reaches any changed symbol is one search from all of them.
    within = C.reached(ids, back, API_DEPTH).select("symbol_id").unionByName(ids)
    apis = M.api_actions(target).join(within, "symbol_id", "left_semi").groupBy("symbol_id").agg(F.min(F.concat("verb", F.lit(" "), "route")).alias("detail")).select(F.lit("api").alias("section"), F.col("symbol_id").alias("id"), "detail")
    clients = M.integrations(touched, target, ways, contents).select(F.lit("integration").alias("section"), F.col("client").alias("id"), F.col("n_connected").cast("string").alias("detail"))
    where = target.join(touched, "symbol_id", "left_semi").unionByName(base.join(diff.where("change = 'removed'"), "symbol_id", "left_semi").select(target.columns))
    of = lambda name, c: where.select(F.lit(name).alias("section"), F.col(c).alias("id")).where("id is not null").distinct().withColumn("detail", F.lit(None).cast("string"))
    changed = diff.select(F.col("change").alias("section"), F.col("symbol_id").alias("id"), F.lit(None).cast("string").alias("detail"))
    reached = impacted.select(F.lit("impacted").alias("section"), F.col("symbol_id").alias("id"), F.col("level").cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, [changed, reached, near, apis, clients, of("service", "project"), of("file", "file_path")])


def asked_evidence(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, selected: int = 20, candidates: int = 40, per_item: int = 12_000) -> DataFrame:
    """(request_id, rank, query_ord, chunk_id, evidence_id, selected, content) of the chunks that a request's queries bring, in order of queries and ranks.

    queries: (request_id, query_ord, project_id, text, vector and, if any, services, symbols or paths). A chunk counts with the first query that brings it; of
    `candidates` chunks a request the first are selected, and of these alone the content is carried, `per_item` characters at most.
    """
    numbered = checkpointed(queries.withColumn("query_id", F.concat_ws("#", "request_id", "query_ord")))
    # Requests name the same services and symptoms: without alike, each would meet all chunks that have them.
    found = R.search(numbered.drop("request_id", "query_ord"), chunks, vectors, alike=True).join(numbered.select("query_id", "request_id", "query_ord"), "query_id")
    merged = checkpointed(R.merge_queries(found, candidates).select("request_id", F.col("merged_rank").alias("rank"), "query_ord", "chunk_id"))
    texts = chunks.select("chunk_id", "content").join(R.small(merged.where(F.col("rank") <= selected).select("chunk_id").distinct()), "chunk_id")
    out = merged.join(texts, "chunk_id", "left")
    traced = P.selection_trace(out, selected, per_item)
    return traced.select("request_id", "rank", "query_ord", "chunk_id", P.evidence_id("chunk", F.col("chunk_id").cast("string")).alias("evidence_id"), "selected", F.when(F.col("selected"), F.col("content")).alias("content"))


def incident_evidence(incidents: DataFrame, events: DataFrame, chunks: DataFrame, vectors: DataFrame, selected: int = 20) -> DataFrame:
    """asked_evidence() of incidents (incident_id, project_id, title, service): their title, first symptoms and service are asked, with the service as a term."""
    told = incidents.join(N.symptoms(events), "incident_id", "left").withColumn("symptoms", F.coalesce("symptoms", F.array().cast("array<string>")))
    asked = P.incident_queries(told).join(incidents.select("incident_id", "project_id", F.array("service").alias("services")), "incident_id")
    return asked_evidence(asked.select(F.col("incident_id").alias("request_id"), "query_ord", "project_id", "text", F.lit(None).cast("array<double>").alias("vector"), "services"), chunks, vectors, selected)


def change_risk_evidence(changes: DataFrame, chunks: DataFrame, vectors: DataFrame, selected: int = 20) -> DataFrame:
    """asked_evidence() of changes (change_id, project_id, summary, paths, symbols): their summary, file names and symbols are asked, with paths and symbols as terms."""
    asked = P.change_queries(changes).join(changes.select("change_id", "project_id", "paths", "symbols"), "change_id")
    return asked_evidence(asked.select(F.col("change_id").alias("request_id"), "query_ord", "project_id", "text", F.lit(None).cast("array<double>").alias("vector"), "paths", "symbols"), chunks, vectors, selected)
