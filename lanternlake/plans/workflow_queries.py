"""Queries of what surrounds a model call, on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternlake.functions import vector as V
from lanternlake.operators import workflow as W
from lanternlake.sources import tables as S

from .retrieval_queries import _CLEAN


def label_ratios(spark, sf):
    l = S.read(spark, sf, "labels").groupBy((F.col("doc_id") % 50).alias("part")).agg(F.sum("toxic").alias("toxic"), F.sum("quality").alias("quality"))  # noqa: E741
    return l.select("part", W.safe_ratio(F.col("toxic"), F.col("quality")).alias("ratio"))


def tool_statuses(spark, sf):
    e = S.read(spark, sf, "events")
    code = F.get(F.array(*map(F.lit, [*W.TOOL_STATUS, "Other"])), (F.col("event_id") % 6).cast("int"))
    return e.select("event_id", W.tool_status(F.when(F.col("event_id") % 7 > 0, code)).alias("status"), W.argument_summary(F.col("props"), 12).alias("arguments"))


def ids_in_rendered_text(spark, sf):
    c = S.read(spark, sf, "conversations")
    text = F.concat(F.lit("ids:\n- chunk:"), "conv_id", F.lit("\n- dependency:a"), "turn", F.lit(" -> b\n-  symbol:X.Y \nno - chunk:1\n- Upper:1\n- "), "text")
    return c.select("conv_id", "turn", F.array_join(F.filter(W.evidence_ids_in(text), lambda x: x.rlike("^(chunk|dependency|symbol):")), "|").alias("ids"))


def metadata_without_nulls(spark, sf):
    n = S.read(spark, sf, "customer")
    m = F.create_map(F.lit("name"), "c_name", F.lit("segment"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")), F.lit("empty"), F.lit(None).cast("string"))
    return W.camel_case(n.select("c_custkey", F.array_join(F.array_sort(F.map_keys(W.without_nulls(m))), ",").alias("kept_keys")))


def union_of_corpora(spark, sf):
    d, p, c = S.read(spark, sf, "documents"), S.read(spark, sf, "pages"), S.read(spark, sf, "conversations")
    parts = d.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "lang"), p.select(F.lit("page").alias("kind"), F.col("page_id").alias("id")), c.select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"))
    return W.union_of(*parts).groupBy("kind", "lang").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def distinct_warnings(spark, sf):
    e = S.read(spark, sf, "events").select(F.concat(F.lit("event type "), "event_type").alias("warning"))
    return W.warnings_of(e, e, S.read(spark, sf, "region").select(F.concat(F.lit("region "), "r_name").alias("warning")))


def tool_output_budget(spark, sf):
    c = S.read(spark, sf, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 5 > 0, F.col("text")).alias("output"))
    return W.tool_output_budget(c, 400).select("request_id", "seq", "body")


def retry_attempts(spark, sf):
    l = S.read(spark, sf, "lineitem")  # noqa: E741
    code = F.get(F.array(*map(F.lit, [*W.TRANSIENT, "VALIDATION", None])), ((F.col("l_partkey") + F.col("l_suppkey")) % 5).cast("int"))
    return W.retried(l.groupBy(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("attempt")).agg(F.max(code).alias("code")))


def repair_outcomes(spark, sf):
    l = S.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("attempt")).agg(F.max("l_partkey").alias("k"))  # noqa: E741
    errors = F.when(F.col("k") % 3 == 0, F.array().cast("array<string>")).when(F.col("k") % 3 == 1, F.array(F.concat(F.lit("e"), F.col("k") % 10)))
    out = W.validated(l.select("request_id", "attempt", errors.alias("errors")))
    return out.withColumn("errors", F.array_join("errors", ","))


def embedding_errors(spark, sf):
    d = S.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 9 > 0, F.col("text")).otherwise(F.lit(" \n")).alias("content"))
    return W.embedded(d, V.embed_text, 8, 5_000).select("chunk_id", F.round(V.norm(F.col("vector")), 6).alias("length"), "error")


def document_upsert(spark, sf):
    d = S.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "source")
    old = d.where("document_id % 4 > 0").withColumn("version", F.lit(1))
    status = d.select("document_id", F.expr("CASE WHEN document_id % 4 = 0 THEN 'new' WHEN document_id % 4 = 1 THEN 'changed' WHEN document_id % 12 = 2 THEN 'deleted' WHEN document_id % 12 = 3 THEN 'error' ELSE 'skipped' END").alias("status"))
    return W.upserted(old, d.withColumn("version", F.lit(2)), status)


def trace_counts(spark, sf):
    e = S.read(spark, sf, "events")
    calls = e.where("user_id % 3 > 0").select(F.col("user_id").alias("run_id"), F.when(F.col("event_id") % 4 > 0, "executed").otherwise("rejected").alias("status"))
    return W.trace_counts(calls, e.where("user_id % 3 < 2").select(F.col("user_id").alias("run_id"), F.concat(F.lit("id:"), F.col("event_id") % 37).alias("evidence_id")))


def run_json(spark, sf):
    return W.as_json(S.read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "n_nationkey")


def change_evidence(spark, sf):
    n = S.read(spark, sf, "supplier")
    part = lambda k, text: n.where(F.col("s_suppkey") % 9 >= k).select((F.col("s_suppkey") % 5).alias("request_id"), F.col("s_suppkey").alias("position"), F.concat(F.lit(text), F.col("s_suppkey") % 11).alias("id"))
    edges = n.select((F.col("s_suppkey") % 5).alias("request_id"), F.col("s_suppkey").alias("position"), F.concat(F.lit("s"), "s_suppkey").alias("from_id"), F.concat(F.lit("n"), "s_nationkey").alias("to_id"))
    return W.change_evidence(*(part(k, text) for k, text in enumerate(["f", "c", "a", "chunk:", "i", "r", "x", "y"])), edges)


QUERIES = {
    f.__name__: f
    for f in (
        label_ratios, tool_statuses, ids_in_rendered_text, metadata_without_nulls, union_of_corpora, distinct_warnings, tool_output_budget, retry_attempts, repair_outcomes,
        embedding_errors, document_upsert, trace_counts, run_json, change_evidence,
    )
}

SQL = {
    "label_ratios": "SELECT doc_id % 50 AS part, CASE WHEN sum(quality) > 0 THEN round(sum(toxic)::DOUBLE / sum(quality), 6) END AS ratio FROM labels GROUP BY 1",
    "tool_statuses": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE (['executed', 'rejected', 'failed', 'not_allowed', 'timeout', 'failed'])[event_id % 6 + 1] END AS status, left(props, 12) AS arguments FROM events""",
    "ids_in_rendered_text": "SELECT conv_id, turn, 'chunk:' || conv_id || '|dependency:a' || turn || ' -> b|symbol:X.Y' AS ids FROM conversations",
    "metadata_without_nulls": """SELECT c_custkey AS "cCustkey", CASE WHEN c_custkey % 3 > 0 THEN 'name,segment' ELSE 'name' END AS "keptKeys" FROM customer""",
    "union_of_corpora": """SELECT kind, lang, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT 'document' AS kind, doc_id AS id, lang FROM documents UNION ALL SELECT 'page', page_id, NULL FROM pages UNION ALL SELECT 'conversation', conv_id, NULL FROM conversations) GROUP BY ALL""",
    "distinct_warnings": "SELECT 'event type ' || event_type AS warning FROM events UNION SELECT 'region ' || r_name FROM region",
    "tool_output_budget": f"""WITH b AS (SELECT conv_id AS request_id, turn AS seq, {_CLEAN("CASE WHEN turn % 5 > 0 THEN text ELSE '' END")} AS body FROM conversations),
      r AS (SELECT *, 200 - coalesce(sum(len(body)) OVER (PARTITION BY request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b)
      SELECT request_id, seq, CASE WHEN regexp_replace(left(body, room::INT), '\\s', '', 'g') = '' THEN '(no output)' ELSE left(body, room::INT) END AS body FROM r WHERE room > 0""",
    "retry_attempts": """WITH o AS (SELECT l_orderkey AS call_id, l_linenumber AS attempt, max((['RATE_LIMITED', 'TIMEOUT', 'UNAVAILABLE', 'VALIDATION', NULL])[(l_partkey + l_suppkey) % 5 + 1]) AS code FROM lineitem GROUP BY ALL),
      m AS (SELECT * FROM o WHERE attempt <= 3 AND NOT EXISTS (SELECT 1 FROM o e WHERE e.call_id = o.call_id AND e.attempt < o.attempt AND (e.code IS NULL OR e.code = 'VALIDATION')))
      SELECT call_id, attempt, code, (['0.0', '5.0', '10.0'])[attempt]::DOUBLE AS delay, attempt = max(attempt) OVER (PARTITION BY call_id) AS final FROM m""",
    "repair_outcomes": """WITH o AS (SELECT l_orderkey AS request_id, l_linenumber AS attempt, max(l_partkey) AS k FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
      g AS (SELECT request_id, min(attempt) FILTER (WHERE k % 3 = 0) AS ok, max(attempt) AS made, arg_max(k, attempt) AS k FROM o GROUP BY 1)
      SELECT request_id, CASE WHEN ok = 1 THEN 'valid' WHEN ok > 1 THEN 'repaired' ELSE 'failed' END AS status, coalesce(ok, made) AS attempts, CASE WHEN ok IS NOT NULL THEN '' WHEN k % 3 = 1 THEN 'e' || (k % 10) ELSE 'no usable output' END AS errors FROM g""",
    "embedding_errors": r"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR trim(coalesce(text, ''), E' \t\n\r') = '' THEN 'EMPTY' WHEN len(text) > 5000 THEN 'TOO_LONG' END AS error FROM documents) SELECT doc_id AS chunk_id, CASE WHEN error IS NULL THEN 1.0::DOUBLE END AS length, error FROM e""",
    "document_upsert": """SELECT doc_id AS document_id, source, 1 AS version FROM documents WHERE doc_id % 4 > 1 AND doc_id % 12 <> 2 UNION ALL SELECT doc_id, source, 2 FROM documents WHERE doc_id % 4 < 2""",
    "trace_counts": """WITH a AS (SELECT user_id, count(*) AS c, count(*) FILTER (WHERE event_id % 4 > 0) AS x FROM events WHERE user_id % 3 > 0 GROUP BY 1), b AS (SELECT user_id, count(DISTINCT event_id % 37) AS n FROM events WHERE user_id % 3 < 2 GROUP BY 1)
      SELECT coalesce(a.user_id, b.user_id) AS run_id, coalesce(c, 0) AS n_calls, coalesce(x, 0) AS n_executed, coalesce(n, 0) AS n_evidence_ids FROM a FULL JOIN b ON a.user_id = b.user_id""",
    "run_json": """SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS json FROM nation""",
    "change_evidence": """WITH s AS (SELECT s_suppkey % 5 AS request_id, s_suppkey AS position, s_suppkey % 11 AS k, s_suppkey % 9 AS m, s_nationkey FROM supplier)
      SELECT request_id, i::INT AS section, position, (['change:f', 'component:c', 'api:a', 'chunk:', 'incident:i', 'runbook:r', 'symbol:x', 'symbol:y'])[i + 1] || k AS evidence_id FROM s JOIN range(8) t(i) ON m >= i
      UNION ALL SELECT request_id, 8, position, 'dependency:s' || position || ' -> n' || s_nationkey FROM s""",
}
