"""Queries of the compositions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternlake.operators import change as C
from lanternlake.operators import evaluation as E
from lanternlake.operators import workflows as L
from lanternlake.plans import operations_queries as O
from lanternlake.plans import symbol_queries as Y
from lanternlake.plans.retrieval_queries import DOCS, KEYWORD_SQL
from lanternlake.sources import tables as S


def _version(spark, sf, missing: int, changed: int | None):
    n = F.col("n")
    salt = F.lit("") if changed is None else F.when(n % changed == 0, "changed").otherwise("")
    rows = Y.symbols(spark, sf).where(n.isNull() | (n % missing != 0))
    return rows.withColumn("declaration_hash", F.sha2(F.concat("fqn", salt), 256)).withColumn("project", F.regexp_extract("file_path", "Brand#([0-9]+)", 1)).drop("n")


def change_model(spark, sf):
    base, target = _version(spark, sf, 490, None), _version(spark, sf, 770, 600)
    return L.change_model(base, target, Y.edges(spark, sf), Y._contents(spark, sf))


def incident_evidence(spark, sf):
    """Incidents whose id divides by 20 ask all documents of their project."""
    i = O.incidents(spark, sf).where("incident_id % 20 = 0").select("incident_id", "project_id", "title", F.concat(F.lit("src"), F.col("incident_id") % 20).alias("service"))
    out = L.incident_evidence(i, O.events(spark, sf), S.documents(spark, sf), S.vectors(spark, sf), selected=5)
    return out.select("request_id", "rank", "query_ord", "chunk_id", "evidence_id", "selected", F.length("content").alias("n_content"))


def names_in_order(spark, sf):
    p = S.read(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name"))
    nodes = p.select(F.col("p_partkey").alias("symbol_id"), name.alias("name"), F.col("p_brand").alias("project"))
    return C.by_name(nodes)


def matched_sources(spark, sf):
    """Parts cited under their names in one case or another."""
    p = S.read(spark, sf, "part")
    gold = p.select(F.col("p_brand").alias("case_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey") % 50).alias("source_key"))
    cited = p.where("p_partkey % 3 <> 0").select(F.col("p_brand").alias("case_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey") % 50).alias("k"), "p_partkey")
    return E.matched_sources(cited.select("case_id", F.when(F.col("p_partkey") % 2 == 0, F.upper("k")).otherwise(F.col("k")).alias("source_key")), gold)


QUERIES = {f.__name__: f for f in (change_model, incident_evidence, names_in_order, matched_sources)}

SQL = {
    "names_in_order": "SELECT p_partkey AS symbol_id, name, p_brand AS project, row_number() OVER (PARTITION BY p_brand ORDER BY lower(name), name, p_partkey)::INT AS place FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') ELSE p_name END AS name FROM part)",
    "matched_sources": """WITH g AS (SELECT DISTINCT p_brand AS case_id, p_name || ' ' || (p_partkey % 50) AS source_key FROM part), c AS (SELECT DISTINCT p_brand AS case_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name || ' ' || (p_partkey % 50)) ELSE p_name || ' ' || (p_partkey % 50) END AS k FROM part WHERE p_partkey % 3 <> 0)
      SELECT g.case_id, source_key, coalesce(max(CASE WHEN k = source_key THEN k END), min(k)) AS cited_key, CASE WHEN bool_or(k = source_key) THEN 'exact' WHEN count(k) > 0 THEN 'case-blind' END AS tier FROM g LEFT JOIN c ON c.case_id = g.case_id AND lower(k) = lower(source_key) GROUP BY 1, 2""",
    "incident_evidence": f"""WITH {DOCS}, {O.EVENTS_SQL}, {O.INCIDENTS_SQL}, i AS (SELECT incident_id, project_id, title, 'src' || (incident_id % 20) AS service FROM inc WHERE incident_id % 20 = 0),
      f AS (SELECT incident_id, message, row_number() OVER (PARTITION BY incident_id ORDER BY occurred_at, event_id) AS n FROM ev WHERE type IN ('Error', 'Log')),
      y AS (SELECT incident_id, message, row_number() OVER (PARTITION BY incident_id ORDER BY min(n)) AS k FROM f WHERE n <= 20 GROUP BY incident_id, message QUALIFY k <= 5),
      a AS (SELECT incident_id, project_id, service, title AS text, 0 AS k FROM i UNION ALL SELECT incident_id, project_id, service, message, k FROM i JOIN y USING (incident_id) UNION ALL SELECT incident_id, project_id, service, service, 100 FROM i),
      qs AS (SELECT incident_id || '#' || (row_number() OVER (PARTITION BY incident_id ORDER BY k) - 1) AS query_id, incident_id AS request_id, (row_number() OVER (PARTITION BY incident_id ORDER BY k) - 1)::INT AS query_ord, project_id, text, service AS wanted FROM a), {KEYWORD_SQL},
      dleg AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM docs JOIN qs USING (project_id) WHERE service = wanted QUALIFY rank <= 50),
      fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM kleg UNION ALL SELECT * FROM dleg) GROUP BY ALL),
      hits AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM fused QUALIFY r <= 10),
      once AS (SELECT request_id, query_ord, r, chunk_id FROM hits JOIN qs USING (query_id) QUALIFY row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY query_ord, r) = 1),
      m AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY query_ord, r)::INT AS rank, query_ord, chunk_id FROM once QUALIFY rank <= 40)
      SELECT request_id, rank, query_ord, chunk_id, 'chunk:' || chunk_id AS evidence_id, rank <= 5 AS selected, CASE WHEN rank <= 5 THEN least(len(content), 12000)::INT END AS n_content FROM m JOIN docs USING (chunk_id)""",
}
