"""Queries of change intelligence, incidents and runs on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlake.functions import text as X
from lanternlake.operators import change as C
from lanternlake.operators import incidents as N
from lanternlake.operators import runs as R
from lanternlake.sources import tables as S

# ---------------------------------------------------------------- the graph: orders use parts, parts come from suppliers


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(from_id, to_id): o<order> -> p<part> and p<part> -> s<supplier>, of all line items."""
    l = S.read(spark, sf, "lineitem")  # noqa: E741
    part = F.concat(F.lit("p"), "l_partkey")
    both = F.array(F.struct(F.concat(F.lit("o"), "l_orderkey").alias("from_id"), part.alias("to_id")), F.struct(part.alias("from_id"), F.concat(F.lit("s"), "l_suppkey").alias("to_id")))
    return l.select(F.explode(both).alias("e")).select("e.*")


EDGES_SQL = """l AS (SELECT 'o' || l_orderkey AS o, 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem),
  edges AS (SELECT o AS from_id, p AS to_id FROM l UNION SELECT p, s FROM l)"""


def seeds(spark, sf, prefix="s", below=3):
    e = edges(spark, sf)
    return e.select(F.col("to_id").alias("symbol_id")).where(F.col("to_id").rlike(f"^{prefix}[0-9]$") & (F.substring("to_id", 2, 9).cast("int") < below)).distinct()


def seeds_sql(prefix="s", below=3):
    return f"seeds AS (SELECT DISTINCT to_id AS symbol_id FROM edges WHERE regexp_full_match(to_id, '{prefix}[0-9]') AND substr(to_id, 2)::INT < {below})"


def _reach_sql(depth: int, table: str = "edges") -> str:
    return f"""walk AS (WITH RECURSIVE w(symbol_id, level) AS (SELECT symbol_id, 0 FROM seeds UNION SELECT e.from_id, level + 1 FROM w JOIN {table} e ON e.to_id = w.symbol_id WHERE level < {depth})
      SELECT symbol_id, min(level)::INT AS level FROM w GROUP BY 1)"""


def impact_bfs(spark, sf):
    return C.reach(seeds(spark, sf), edges(spark, sf), 2)


def related_bfs(spark, sf):
    return C.reach(seeds(spark, sf, "s", 1), edges(spark, sf), 2, both_ways=True)


def reachability_5hop(spark, sf):
    return C.reach(seeds(spark, sf, "s", 1), edges(spark, sf), 5, both_ways=True)


def dependency_paths(spark, sf):
    return C.dependency_paths(seeds(spark, sf), edges(spark, sf), 2)


def edges_touching(spark, sf):
    return C.touching(seeds(spark, sf), edges(spark, sf))


def direct_dependents(spark, sf):
    e = edges(spark, sf)
    nodes = e.select(F.col("from_id").alias("symbol_id")).distinct().withColumn("fqn", F.col("symbol_id"))
    return C.direct(nodes, e, "s1", dependents=True).select("symbol_id")


_BOTH_SQL = "bi AS (SELECT from_id, to_id FROM edges UNION SELECT to_id, from_id FROM edges)"


def symbols(spark, sf, version: str) -> DataFrame:
    """part as the symbols of two versions: some missing in either, some with another declaration."""
    p = S.read(spark, sf, "part")
    n = F.col("p_partkey")
    keep, salt = (n % 10 != 0, F.lit("")) if version == "base" else (n % 7 != 0, F.when(n % 11 == 0, "changed").otherwise(""))
    kind = F.get(F.array(*map(F.lit, ("Class", "Method", "Property", "Field"))), (n % 4).cast("int"))
    return p.where(keep).select(
        F.concat("p_brand", F.lit("."), n).alias("symbol_id"), kind.alias("kind"), F.col("p_type").alias("name"), F.concat("p_brand", F.lit("."), "p_type").alias("fqn"),
        F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_type", F.lit(".cs")).alias("file_path"), F.col("p_brand").alias("project"),
        F.sha2(F.concat("p_brand", "p_type", F.col("p_size").cast("string"), salt), 256).alias("declaration_hash"),
    )


SYMBOLS_SQL = """syms AS (SELECT p_partkey AS n, p_brand || '.' || p_partkey AS symbol_id, ['Class', 'Method', 'Property', 'Field'][(p_partkey % 4 + 1)::INT] AS kind, p_type AS name, p_brand || '.' || p_type AS fqn, p_brand AS project,
    sha256(p_brand || p_type || p_size) AS old, sha256(p_brand || p_type || p_size || CASE WHEN p_partkey % 11 = 0 THEN 'changed' ELSE '' END) AS new FROM part),
  diff AS (SELECT n, symbol_id, kind, name, project, regexp_extract(fqn, '^(.*)\\.[^.]*$', 1) AS declaring, CASE WHEN n % 10 = 0 THEN 'added' WHEN n % 7 = 0 THEN 'removed' ELSE 'modified' END AS change
    FROM syms WHERE (n % 10 <> 0 OR n % 7 <> 0) AND (n % 10 = 0 OR n % 7 = 0 OR old <> new))"""


def symbol_diff(spark, sf):
    return C.symbol_diff(symbols(spark, sf, "base"), symbols(spark, sf, "target"))


def signature_reclass(spark, sf):
    b, t = symbols(spark, sf, "base"), symbols(spark, sf, "target")
    return C.reclassify(C.symbol_diff(b, t), b, t)


_RECLASS_SQL = f"""WITH {SYMBOLS_SQL}, num AS (SELECT *, row_number() OVER (PARTITION BY change, kind, name, declaring ORDER BY symbol_id) AS k FROM diff WHERE change <> 'modified' AND kind <> 'Class'),
  pairs AS (SELECT r.symbol_id AS gone, a.symbol_id AS come FROM num r JOIN num a ON r.kind = a.kind AND r.name = a.name AND r.declaring = a.declaring AND r.k = a.k WHERE r.change = 'removed' AND a.change = 'added')"""


def impacted_services(spark, sf):
    b, t = symbols(spark, sf, "base"), symbols(spark, sf, "target")
    ids = C.changed_symbols(C.symbol_diff(b, t)).where("change = 'modified'")
    return C.impacted_services(t.join(ids, "symbol_id", "left_semi"))


def kind_histogram(spark, sf):
    return C.kind_histogram(symbols(spark, sf, "base"))


def files_to_symbols(spark, sf):
    s = symbols(spark, sf, "base")
    files = s.where("kind = 'Class'").select(F.concat(F.lit("/"), F.upper("file_path")).alias("path")).distinct()
    return C.files_to_symbols(files, s).select("path", F.array_join("symbols", ",").alias("symbols"))


def _signatures(spark, sf):
    p = S.read(spark, sf, "pages")
    verb = F.get(F.array(*map(F.lit, ("HttpGet", "HttpPost", "HttpPut", "HttpPatch", "HttpDelete", "Obsolete"))), (F.col("page_id") % 6).cast("int"))
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    return p.select("page_id", F.concat(F.lit('[Route("/api/'), F.col("page_id") % 9, F.lit('/")]')).alias("controller"), F.concat(F.lit("["), verb, F.lit('("'), path, F.lit('")] public Task<Dto> Run(int id)')).alias("signature"))


def route_extract(spark, sf):
    s = _signatures(spark, sf)
    return s.select("page_id", X.http_verb(F.col("signature")).alias("verb"), X.full_route(X.controller_route(F.col("controller")), F.col("signature")).alias("route"))


# ---------------------------------------------------------------- incidents: users are incidents, their events the timeline

TYPES = {"error": "Error", "view": "Log", "signup": "Deployment", "purchase": "Metric", "click": "Log"}


def events(spark, sf):
    e = S.read(spark, sf, "events")
    kind = F.element_at(F.create_map(*(F.lit(x) for p in TYPES.items() for x in p)), F.col("event_type"))
    return e.select("event_id", F.col("user_id").alias("incident_id"), F.col("ts").cast("timestamp").alias("occurred_at"), kind.alias("type"), F.concat("event_type", F.lit(" "), F.col("user_id") % 7, F.lit(" "), F.col("event_id") % 30).alias("message"))


EVENTS_SQL = """ev AS (SELECT event_id, user_id AS incident_id, ts AS occurred_at, CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Log' WHEN 'signup' THEN 'Deployment' WHEN 'purchase' THEN 'Metric' ELSE 'Log' END AS type,
    event_type || ' ' || (user_id % 7) || ' ' || (event_id % 30) AS message FROM events)"""


def incidents(spark, sf):
    c = S.read(spark, sf, "customer")
    n = F.col("c_custkey")
    return c.select(
        n.alias("incident_id"), F.concat(F.lit("p"), F.col("c_nationkey") % 5).alias("project_id"), F.col("c_name").alias("title"), F.concat(F.lit("Sev"), n % 5 + 1).alias("severity"),
        F.get(F.array(*map(F.lit, ("Open", "Investigating", "Resolved", "Closed"))), (n % 4).cast("int")).alias("status"), F.concat(F.lit("svc"), n % 20).alias("service"),
        F.when(n % 3 > 0, F.col("c_mktsegment")).alias("environment"), F.timestamp_seconds(F.lit(1_700_000_000) + n * 3600).alias("started_at"), F.when(n % 2 == 0, F.timestamp_seconds(F.lit(1_700_000_600) + n * 3600)).alias("detected_at"),
    )


INCIDENTS_SQL = """inc AS (SELECT c_custkey AS incident_id, 'p' || (c_nationkey % 5) AS project_id, c_name AS title, 'Sev' || (c_custkey % 5 + 1) AS severity, ['Open', 'Investigating', 'Resolved', 'Closed'][(c_custkey % 4 + 1)::INT] AS status,
    'svc' || (c_custkey % 20) AS service, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS environment, make_timestamp((1700000000 + c_custkey * 3600) * 1000000) AS started_at, CASE WHEN c_custkey % 2 = 0 THEN make_timestamp((1700000600 + c_custkey * 3600) * 1000000) END AS detected_at FROM customer)"""


def incident_list_page(spark, sf):
    rows = N.with_filters(S.scoped(incidents(spark, sf), "p1"), status="Open", severity=None)
    return N.page(rows, [F.desc("started_at"), F.col("incident_id")], number=2, size=10).select("incident_id", "title", "severity", "started_at", "total")


def incident_search(spark, sf):
    return N.contains_text(incidents(spark, sf), " 0012 ", "title", "environment").select("incident_id", "title")


def incident_timeline(spark, sf):
    return N.timeline(events(spark, sf), 20).select("incident_id", "n", "event_id", "type")


def incident_with_events(spark, sf):
    out = N.with_events(incidents(spark, sf), events(spark, sf))
    return out.select("incident_id", F.size("events").cast("bigint").alias("n_events"), F.get("events", F.lit(0))["event_id"].alias("first_event"), F.get(F.reverse("events"), F.lit(0))["type"].alias("last_type"))


def incident_context(spark, sf):
    out = N.incident_context(incidents(spark, sf), events(spark, sf))
    return out.select("incident_id", F.array_join("known_facts", "|").alias("known_facts"), F.array_join("unknowns", "|").alias("unknowns"), F.array_join("symptoms", "|").alias("symptoms"))


def membership_access(spark, sf):
    c = S.read(spark, sf, "customer")
    role = F.get(F.array(*map(F.lit, ("Owner", "Admin", "Engineer", "Viewer"))), (F.col("c_custkey") % 4).cast("int"))
    members = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("p"), F.col("c_nationkey") % 5).alias("project_id"), role.alias("role"))
    permission = F.get(F.array(*map(F.lit, ("Read", "Write", "Manage"))), (F.col("c_custkey") % 3).cast("int"))
    requests = c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("p"), F.col("c_nationkey") % 5).alias("project_id"), permission.alias("permission"), (F.col("c_custkey") % 97 == 0).alias("is_admin"))
    return N.access(requests, members).select("user_id", "project_id", "permission", "decision")


def last_owners(spark, sf):
    c = S.read(spark, sf, "customer")
    return N.last_owners(c.select(F.concat(F.lit("p"), F.col("c_custkey") % 300).alias("project_id"), F.when(F.col("c_acctbal") > 8000, "Owner").otherwise("Viewer").alias("role")))


def audit_page(spark, sf):
    o = S.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("at"))
    return N.page(o, [F.desc("at"), F.col("o_orderkey")], 1, 500).select("o_orderkey", "o_orderpriority", "total")


def dashboard_counts(spark, sf):
    return N.dashboard(incidents=incidents(spark, sf), events=events(spark, sf), runs=S.read(spark, sf, "orders"), services=S.read(spark, sf, "supplier"))


def slug_unique(spark, sf):
    n = S.read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("My  Service! "), F.col("s_nationkey"), F.lit("_x.")).alias("name"))
    return N.unique_slugs(n, X.slugify(F.col("name"), decompose=False), "s_suppkey").select("s_suppkey", "slug")


def url_validity(spark, sf):
    url = F.col("url")
    odd = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("C:/"), "url")).when(F.col("page_id") % 5 == 1, F.lit("repos/demo")).when(F.col("page_id") % 5 == 2, F.lit("../up")).when(F.col("page_id") % 5 == 3, F.lit("git@host:x/y.git")).otherwise(url)
    return S.read(spark, sf, "pages").select("page_id", X.repository_url_valid(odd).alias("valid"))


def foreign_services(spark, sf):
    i = incidents(spark, sf).select("incident_id", "project_id", F.col("service").alias("affected_service_id"))
    s = S.read(spark, sf, "supplier").select(F.concat(F.lit("p"), F.col("s_nationkey") % 5).alias("project_id"), F.concat(F.lit("svc"), F.col("s_suppkey") % 20).alias("service_id")).distinct()
    return N.foreign_services(i, s).select("incident_id")


# ---------------------------------------------------------------- runs: orders are runs


def _history(spark, sf):
    o = S.read(spark, sf, "orders")
    last = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "O", "Succeeded").otherwise("Running")
    steps = F.when(F.col("o_orderkey") % 13 == 0, F.array(F.lit("Queued"), F.lit("Succeeded"))).when(F.col("o_orderkey") % 17 == 0, F.array(F.lit("Running"), last)).otherwise(F.array(F.lit("Queued"), F.lit("Running"), last))
    return o.select(F.col("o_orderkey").alias("run_id"), F.posexplode(steps).alias("seq", "status"))


def run_state_violations(spark, sf):
    return R.state_violations(_history(spark, sf))


def _runs(spark, sf):
    o = S.read(spark, sf, "orders")
    n = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "F", "Running").when(F.col("o_orderstatus") == "O", "Queued").otherwise("Succeeded")
    return o.select(n.alias("run_id"), (F.col("o_custkey") % 50).alias("project_id"), F.when(n % 5 > 0, F.concat("o_orderpriority", n % 3)).alias("request_id"), at.alias("submitted_at"), F.when(n % 4 > 0, at + F.expr("make_interval(0, 0, 0, cast(o_orderkey % 90 as int), 0, 0, 0)")).alias("finished_at"), status.alias("status"), F.lit(None).cast("string").alias("failure_code"))


def run_idempotency(spark, sf):
    return R.idempotency(_runs(spark, sf)).select("run_id", "decision")


def run_recovery(spark, sf):
    return R.recovered(_runs(spark, sf)).select("run_id", "status", "failure_code", "requeue")


def job_timeouts(spark, sf):
    r = _runs(spark, sf).select("run_id", F.col("submitted_at").alias("started_at"), F.col("finished_at").alias("completed_at"), F.lit("1998-12-31").cast("timestamp").alias("now"))
    return R.timed_out(r, 60 * 86_400).select("run_id")


def rate_limit_fixed_window(spark, sf):
    e = S.read(spark, sf, "events").select("event_id", "ts")
    return R.rate_limited(e, seconds=3600).select("event_id", "label")


def failure_category(spark, sf):
    code = F.get(F.array(*map(F.lit, (*X.FAILURE_CATEGORIES, "QUEUE_FULL"))), (F.col("o_orderkey") % 8).cast("int"))
    return S.read(spark, sf, "orders").groupBy(X.failure_category(code).alias("category")).agg(F.count("*").alias("n"))


def queue_admission(spark, sf):
    o = S.read(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    s = o.select(F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("run_id"), at.alias("submitted_at"), (at + F.expr("make_interval(0, 0, 0, cast(o_orderkey % 200 as int), 0, 0, 0)")).alias("started_at"))
    return R.queue_admission(s, 100).select("run_id", "rejected")


def hourly_events(spark, sf):
    """The tumbling window of the stream, as a batch."""
    e = events(spark, sf)
    return e.groupBy(F.window("occurred_at", "1 hour").alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def last_deployment(spark, sf):
    """Extension: the last deployment before each incident began."""
    e = events(spark, sf).select(F.concat(F.lit("p"), F.col("incident_id") % 5).alias("project_id"), "occurred_at", "type")
    i = incidents(spark, sf).withColumn("started_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("incident_id") * 86_400))
    return N.last_deployment(i, e).select("incident_id", "deployed_at")


QUERIES = {
    f.__name__: f
    for f in (
        impact_bfs, related_bfs, reachability_5hop, dependency_paths, edges_touching, direct_dependents, symbol_diff, signature_reclass, impacted_services, kind_histogram, files_to_symbols, route_extract,
        incident_list_page, incident_search, incident_timeline, incident_with_events, incident_context, membership_access, last_owners, audit_page, dashboard_counts, slug_unique, url_validity, foreign_services,
        run_state_violations, run_idempotency, run_recovery, job_timeouts, rate_limit_fixed_window, failure_category, queue_admission, hourly_events, last_deployment,
    )
}

_RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey % 50 AS project_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority || (o_orderkey % 3) END AS request_id, o_orderdate AS submitted_at,
    CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + to_days((o_orderkey % 90)::INT) END AS finished_at, CASE o_orderstatus WHEN 'F' THEN 'Running' WHEN 'O' THEN 'Queued' ELSE 'Succeeded' END AS status FROM orders)"""

SQL = {
    "impact_bfs": f"WITH {EDGES_SQL}, {seeds_sql()}, {_reach_sql(2)} SELECT * FROM walk WHERE level > 0",
    "related_bfs": f"WITH {EDGES_SQL}, {_BOTH_SQL}, {seeds_sql('s', 1)}, {_reach_sql(2, 'bi')} SELECT * FROM walk WHERE level > 0",
    "reachability_5hop": f"WITH {EDGES_SQL}, {_BOTH_SQL}, {seeds_sql('s', 1)}, {_reach_sql(5, 'bi')} SELECT * FROM walk WHERE level > 0",
    "dependency_paths": f"WITH {EDGES_SQL}, {_BOTH_SQL}, {seeds_sql()}, {_reach_sql(2, 'bi')} SELECT from_id, to_id FROM edges WHERE from_id IN (SELECT symbol_id FROM walk) AND to_id IN (SELECT symbol_id FROM walk)",
    "edges_touching": f"WITH {EDGES_SQL}, {seeds_sql()} SELECT from_id, to_id FROM edges WHERE from_id IN (FROM seeds) OR to_id IN (FROM seeds)",
    "direct_dependents": f"WITH {EDGES_SQL} SELECT DISTINCT from_id AS symbol_id FROM edges WHERE to_id = 's1'",
    "symbol_diff": f"WITH {SYMBOLS_SQL} SELECT symbol_id, change FROM diff",
    "signature_reclass": f"{_RECLASS_SQL} SELECT symbol_id, CASE WHEN symbol_id IN (SELECT come FROM pairs) THEN 'modified' ELSE change END AS change FROM diff WHERE symbol_id NOT IN (SELECT gone FROM pairs)",
    "impacted_services": f"WITH {SYMBOLS_SQL} SELECT DISTINCT project FROM diff WHERE change = 'modified'",
    "kind_histogram": f"WITH {SYMBOLS_SQL} SELECT kind, count(*) AS n FROM syms WHERE n % 10 <> 0 GROUP BY 1",
    "files_to_symbols": f"""WITH {SYMBOLS_SQL}, s AS (SELECT *, 'src/' || project || '/' || name || '.cs' AS file_path FROM syms WHERE n % 10 <> 0)
      SELECT path, string_agg(DISTINCT fqn, ',' ORDER BY fqn) AS symbols FROM (SELECT DISTINCT '/' || upper(file_path) AS path FROM s WHERE kind = 'Class') f JOIN s ON lower(file_path) = lower(substr(path, 2)) GROUP BY path""",
    "route_extract": r"""WITH s AS (SELECT page_id, page_id % 9 AS c, page_id % 6 AS v, trim(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/') AS path FROM pages)
      SELECT page_id, CASE WHEN v < 5 THEN ['GET', 'POST', 'PUT', 'PATCH', 'DELETE'][(v + 1)::INT] END AS verb, '/api/' || c || CASE WHEN v < 5 AND path <> '' THEN '/' || path ELSE '' END AS route FROM s""",
    "incident_list_page": f"WITH {INCIDENTS_SQL} SELECT incident_id, title, severity, started_at, count(*) OVER () AS total FROM inc WHERE project_id = 'p1' AND status = 'Open' ORDER BY started_at DESC, incident_id LIMIT 10 OFFSET 10",
    "incident_search": f"WITH {INCIDENTS_SQL} SELECT incident_id, title FROM inc WHERE contains(lower(title), '0012') OR contains(lower(coalesce(environment, '')), '0012')",
    "incident_timeline": f"WITH {EVENTS_SQL} SELECT * FROM (SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY occurred_at, event_id)::INT AS n, event_id, type FROM ev) WHERE n <= 20",
    "incident_with_events": f"WITH {EVENTS_SQL}, {INCIDENTS_SQL} SELECT incident_id, count(event_id) AS n_events, first(event_id ORDER BY occurred_at, event_id) AS first_event, last(type ORDER BY occurred_at, event_id) AS last_type FROM inc LEFT JOIN ev USING (incident_id) GROUP BY 1",
    "incident_context": f"""WITH {EVENTS_SQL}, {INCIDENTS_SQL},
      f AS (SELECT incident_id, message, row_number() OVER (PARTITION BY incident_id ORDER BY occurred_at, event_id) AS n FROM ev WHERE type IN ('Error', 'Log')),
      y AS (SELECT incident_id, string_agg(message, '|' ORDER BY n) AS symptoms FROM (SELECT incident_id, message, min(n) AS n FROM f WHERE n <= 20 GROUP BY ALL) GROUP BY 1),
      k AS (SELECT incident_id, bool_or(type = 'Deployment') AS d, bool_or(type = 'Metric') AS m FROM ev GROUP BY 1)
      SELECT incident_id, 'Incident: ' || title || '|Severity: ' || severity || '|Started at: ' || strftime(started_at, '%Y-%m-%dT%H:%M:%S.%fZ') || coalesce('|Environment: ' || environment, '') || '|Affected service: ' || service || coalesce('|Detected at: ' || strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%fZ'), '') AS known_facts,
        concat_ws('|', CASE WHEN detected_at IS NULL THEN 'No detection timestamp was supplied.' END, CASE WHEN NOT coalesce(d, false) THEN 'No deployment events were supplied; the change window is unknown.' END,
          CASE WHEN symptoms IS NULL THEN 'No error or log samples were supplied.' END, CASE WHEN NOT coalesce(m, false) THEN 'No metric/telemetry data was available.' END) AS unknowns, coalesce(symptoms, '') AS symptoms
      FROM inc LEFT JOIN y USING (incident_id) LEFT JOIN k USING (incident_id)""",
    "membership_access": """SELECT c_custkey AS user_id, 'p' || (c_nationkey % 5) AS project_id, ['Read', 'Write', 'Manage'][(c_custkey % 3 + 1)::INT] AS permission,
      CASE WHEN c_custkey % 97 = 0 THEN 'allowed' WHEN c_custkey % 5 = 0 THEN 'not_found' WHEN c_custkey % 4 < 2 OR c_custkey % 4 = 2 AND c_custkey % 3 < 2 OR c_custkey % 3 = 0 THEN 'allowed' ELSE 'forbidden' END AS decision FROM customer""",
    "last_owners": "SELECT 'p' || (c_custkey % 300) AS project_id FROM customer GROUP BY 1 HAVING count(*) FILTER (WHERE c_acctbal > 8000) = 1",
    "audit_page": "SELECT o_orderkey, o_orderpriority, count(*) OVER () AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "dashboard_counts": "SELECT 'incidents' AS name, count(*) AS n FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'runs', count(*) FROM orders UNION ALL SELECT 'services', count(*) FROM supplier",
    "slug_unique": "SELECT s_suppkey, 'my-service-' || s_nationkey || '-x' || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)",
    "url_validity": "SELECT page_id, page_id % 5 NOT IN (0, 2) AS valid FROM pages",
    "foreign_services": f"WITH {INCIDENTS_SQL} SELECT incident_id FROM inc WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE 'p' || (s_nationkey % 5) = project_id AND 'svc' || (s_suppkey % 20) = service)",
    "run_state_violations": """SELECT * FROM (
      SELECT o_orderkey AS run_id, 1 AS seq, 'Queued' AS from_status, 'Succeeded' AS to_status FROM orders WHERE o_orderkey % 13 = 0
      UNION ALL SELECT o_orderkey, 0, NULL, 'Running' FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 = 0
      UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 2 END, 'Running', 'Running' FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderstatus NOT IN ('F', 'O'))""",
    "run_idempotency": f"""WITH RECURSIVE {_RUNS_SQL}, k AS (SELECT *, coalesce(finished_at, TIMESTAMP '9999-12-31') AS ends, row_number() OVER (PARTITION BY project_id, request_id ORDER BY submitted_at, run_id) AS n FROM runs WHERE request_id IS NOT NULL),
      w AS (SELECT project_id, request_id, n, run_id, ends AS busy, 'started' AS decision FROM k WHERE n = 1
        UNION ALL SELECT k.project_id, k.request_id, k.n, k.run_id, CASE WHEN busy > submitted_at THEN busy ELSE greatest(busy, ends) END, CASE WHEN busy > submitted_at THEN 'reused' ELSE 'started' END FROM w JOIN k ON k.project_id = w.project_id AND k.request_id = w.request_id AND k.n = w.n + 1)
      SELECT run_id, decision FROM w UNION ALL SELECT run_id, 'started' FROM runs WHERE request_id IS NULL""",
    "run_recovery": f"WITH {_RUNS_SQL} SELECT run_id, CASE WHEN status = 'Running' THEN 'Failed' ELSE status END AS status, CASE WHEN status = 'Running' THEN 'WORKER_INTERRUPTED' END AS failure_code, status = 'Queued' AS requeue FROM runs",
    "job_timeouts": f"WITH {_RUNS_SQL} SELECT run_id FROM runs WHERE coalesce(finished_at, TIMESTAMP '1998-12-31') - submitted_at > INTERVAL 60 DAYS",
    "rate_limit_fixed_window": "SELECT event_id, CASE WHEN n <= 10 THEN 'admitted' WHEN n <= 14 THEN 'queued' ELSE 'rejected' END AS label FROM (SELECT event_id, row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS n FROM events)",
    "failure_category": "SELECT ['VALIDATION', 'RATE_LIMIT', 'TIMEOUT', 'AI_PROVIDER', 'TIMEOUT', 'VALIDATION', 'INTERNAL', 'INTERNAL'][(o_orderkey % 8 + 1)::INT] AS category, count(*) AS n FROM orders GROUP BY 1",
    "queue_admission": """WITH RECURSIVE s AS (SELECT o_orderpriority AS queue, o_orderkey AS run_id, o_orderdate AS a, o_orderdate + to_days((o_orderkey % 200)::INT) AS b, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
      w AS (SELECT queue, n, run_id, [b] AS waiting, false AS rejected FROM s WHERE n = 1
        UNION ALL SELECT queue, n, run_id, CASE WHEN len(still) >= 100 THEN still ELSE list_append(still, b) END, len(still) >= 100 FROM (SELECT s.*, list_filter(w.waiting, lambda x: x > s.a) AS still FROM w JOIN s ON s.queue = w.queue AND s.n = w.n + 1))
      SELECT run_id, rejected FROM w""",
    "hourly_events": f"WITH {EVENTS_SQL} SELECT date_trunc('hour', occurred_at) AS start, type, count(*) AS n FROM ev GROUP BY ALL",
    "last_deployment": f"""WITH {EVENTS_SQL}, {INCIDENTS_SQL}, i AS (SELECT incident_id, project_id, make_timestamp((1704067200 + incident_id * 86400) * 1000000) AS started_at FROM inc)
      SELECT i.incident_id, max(occurred_at) AS deployed_at FROM i LEFT JOIN (SELECT *, 'p' || (incident_id % 5) AS project_id FROM ev WHERE type = 'Deployment') d ON d.project_id = i.project_id AND d.occurred_at <= i.started_at GROUP BY i.incident_id""",
}
