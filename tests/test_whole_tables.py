"""Queries whose results take all rows of their tables: ids of any size, items without a vector, whole texts, spread groups."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from lanternlake.operators import evidence as P
from lanternlake.operators import incidents as N
from lanternlake.operators import ingest as I
from lanternlake.plans import operations_queries as O
from lanternlake.plans import retrieval_queries as Q


def test_items_without_a_vector_are_searched_by_their_words(spark, tmp_path):
    spark.createDataFrame([(7, "alpha beta")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(8, [1.0, 0.0], 0)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(2, "beta gamma", "en", "src7")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = Q.hybrid_search(spark, str(tmp_path)).collect()
    assert [(r.query_id, r.chunk_id, r.vector, r.keyword, r.dependency) for r in found] == [(7, 2, None, 1, 1)]


def test_reach_equals_a_plain_search(spark, sf_dir, duck):
    near: dict[str, set] = {}
    for o, p, s in duck.execute("SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 's' || l_suppkey FROM lineitem").fetchall():
        for a, b in ((o, p), (p, s)):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    level = {x: 0 for x in ("s0",) if x in near}
    front = list(level)
    for n in range(1, 6):
        front = {b for a in front for b in near[a]} - set(level)
        level |= dict.fromkeys(front, n)
    found = {r.symbol_id: r.level for r in O.reachability_5hop(spark, sf_dir).collect()}
    assert found == {x: n for x, n in level.items() if n > 0}


def test_index_and_deployments_take_ids_of_any_size(spark, tmp_path):
    day = datetime(2024, 1, 1)
    spark.createDataFrame([(1999, 1, day, "view"), (2000, 1, day, "error"), (5000, 201, day, "signup")], "event_id bigint, user_id bigint, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0, "text", "en", "src0")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, 1, "name", "segment") for n in (199, 200, 201)], "c_custkey bigint, c_nationkey bigint, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    ids = {r.evidence_id for r in Q.evidence_index(spark, str(tmp_path)).collect()}
    assert {f"incident-event:{n}" for n in (1999, 2000, 5000)} <= ids
    found = {r.incident_id: r.deployed_at for r in O.last_deployment(spark, str(tmp_path)).collect()}
    assert set(found) == {199, 200, 201} and None not in found.values()


def test_last_deployment_is_no_join_of_pairs(spark):
    """Against plain Python: equal times, the same hour, hours between, none before, missing project or time; and no join by project alone."""
    day = datetime(2024, 1, 1)
    events = [(f"p{n % 3}", day + timedelta(minutes=n * n % 997), "Deployment" if n % 4 else "Log") for n in range(120)] + [(None, day, "Deployment"), ("p1", None, "Deployment")]
    incidents = [(n, f"p{n % 4}", day + timedelta(minutes=n * 13 % 1100 - 5)) for n in range(90)] + [(90, None, day), (91, "p1", None), (92, "p1", events[1][1])]
    e = spark.createDataFrame(events, "project_id string, occurred_at timestamp, type string")
    out = N.last_deployment(spark.createDataFrame(incidents, "incident_id bigint, project_id string, started_at timestamp"), e)
    expected = {n: max((t for q, t, kind in events if kind == "Deployment" and p is not None and q == p and t is not None and s is not None and t <= s), default=None) for n, p, s in incidents}
    rows = out.collect()
    assert len(rows) == len(incidents) and {r.incident_id: r.deployed_at for r in rows} == expected
    joins = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[([^\]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    assert joins and all("hour" in keys for keys in joins)


TEXTS = {
    0: "public class A {\n  public int Run(int x) {\n    return x;\n  }\n}\n",
    4: "no declaration here\nnor here",
    8: "public class Open {\n  public void Go() {\n",
    12: "",
}


def test_code_chunks_reads_the_documents_own_texts(spark, tmp_path):
    spark.createDataFrame([(k, t, "en", "src0") for k, t in TEXTS.items()], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.document_id, r.position, r.chunk_type, r.symbol) for r in Q.code_chunks(spark, str(tmp_path)).collect())
    assert found == [(0, 0, "Class", "A"), (0, 1, "Method", "Run"), (4, 0, "File", None), (8, 0, "Class", "Open"), (8, 1, "Method", "Go"), (12, 0, "File", None)]


def test_code_chunks_keep_the_whole_text(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "document_id bigint, content string")
    found = {(r.document_id, r.position): r.chunk for r in I.code_chunks(docs).collect()}
    assert found == {(0, 0): TEXTS[0].rstrip("\n"), (0, 1): "  public int Run(int x) {\n    return x;\n  }", (4, 0): TEXTS[4], (8, 0): TEXTS[8], (8, 1): "  public void Go() {\n", (12, 0): ""}


def _windows(df) -> list[str]:
    return re.findall(r"windowspecdefinition\(([^)]*)", df._jdf.queryExecution().analyzed().toString())


def test_pack_spends_the_budget_in_parts_first(spark):
    items = [("r" if n % 5 else None, n, None if n % 50 == 0 else n * 7 % 40 / 40, " " if n % 11 == 0 else "ab cd\n" * (n % 9 + 1)) for n in range(600)]
    out = P.pack(spark.createDataFrame(items, "request_id string, item_id bigint, score double, content string"), budget=301, per_item=40)
    expected = set()
    for request in ("r", None):
        left, order = 301, 0
        for _, n, _, text in sorted((x for x in items if x[0] == request), key=lambda x: (x[2] is not None, -(x[2] or 0), x[1])):
            text = "\n".join(text.splitlines())
            part = text[:40]
            if part.strip(" ") and left > 0:
                cut, order = part[:left], order + 1
                expected.add((request, order, n, cut, len(cut) < len(text) or len(cut) == left))
                left -= len(part)
    assert {tuple(r) for r in out.collect()} == expected and len(expected) > 10
    assert any(re.match(r"request_id#\d+, deal#\d+", w) for w in _windows(out))
