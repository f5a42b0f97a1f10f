"""Compositions on hand-made inputs, and a stream with bad lines and failures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lanternlake.operators import change as C
from lanternlake.operators import sinks as W
from lanternlake.operators import workflows as L
from lanternlake.streaming import ingest as G
from lanternlake.streaming import runs as T

SYMBOL = "symbol_id string, fqn string, name string, kind string, signature string, parameters array<string>, return_type string, file_path string, declaration_hash string, project string"


def symbol(fqn, kind, h, signature=None, returns=None, file="src/a.cs", project="a"):
    return fqn, fqn, fqn.partition("(")[0].rpartition(".")[2], kind, signature, [], returns, file, h, project


def test_a_change_as_one_model(spark):
    controller, get = symbol("A.OController", "Class", "1", '[Route("o")]'), symbol("A.OController.Get()", "Method", "1", "[HttpGet] Get")
    same = [controller, get, symbol("A.Client", "Class", "1", None, None, "src/client.cs"), symbol("A.Client.http", "Field", "1", None, "HttpClient", "src/client.cs")]
    base = spark.createDataFrame([*same, symbol("A.S", "Class", "1"), symbol("A.S.Run(int)", "Method", "1"), symbol("A.S.Old()", "Method", "1", file="src/old.cs", project="old"), symbol("A.S.Keep()", "Method", "1")], SYMBOL)
    target = spark.createDataFrame([*same, symbol("A.S", "Class", "1"), symbol("A.S.Run(string)", "Method", "2"), symbol("A.S.Keep()", "Method", "9"), symbol("A.S.New()", "Method", "1", file=None, project=None)], SYMBOL)
    edges = spark.createDataFrame([("A.OController.Get()", "A.S.Run(string)"), ("A.S.Run(string)", "A.Client.http"), ("A.Client.http", "A.Far"), ("A.S.Keep()", "A.S.Keep()")], "from_id string, to_id string")
    contents = spark.createDataFrame([("src/client.cs", '"/x"')], "path string, content string")
    found = {tuple(r) for r in L.change_model(base, target, edges, contents).collect()}
    assert found == {
        ("added", "A.S.New()", None), ("removed", "A.S.Old()", None), ("modified", "A.S.Run(string)", None), ("modified", "A.S.Keep()", None), ("impacted", "A.OController.Get()", "1"),
        ("edge", "A.OController.Get() -> A.S.Run(string)", None), ("edge", "A.S.Run(string) -> A.Client.http", None), ("edge", "A.S.Keep() -> A.S.Keep()", None), ("api", "A.OController.Get()", "GET /o"), ("integration", "A.Client", "1"),
        ("service", "a", None), ("service", "old", None), ("file", "src/a.cs", None), ("file", "src/old.cs", None),
    }
    assert {r.section for r in L.change_model(base, base, edges, contents).collect()} == set()


def test_a_change_asks_for_its_actions_in_one_search(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("a search for each changed symbol")

    monkeypatch.setattr(L.M, "walked", fail)
    actions = [symbol("A.OController", "Class", "1"), *(symbol(f"A.OController.M{k}()", "Method", "1", "[HttpGet] M") for k in range(8))]
    base = spark.createDataFrame([*actions, symbol("A.S.Run()", "Method", "1")], SYMBOL)
    target = spark.createDataFrame([*actions[:-1], symbol("A.OController.M7()", "Method", "2", "[HttpGet] M"), symbol("A.S.Run()", "Method", "2")], SYMBOL)
    names = ["A.S.Run()", *(f"A.OController.M{k}()" for k in range(7))]
    edges = spark.createDataFrame(list(zip(names[1:], names)), "from_id string, to_id string")
    out = L.change_model(base, target, edges, spark.createDataFrame([], "path string, content string")).where("section = 'api'")
    assert {r.id for r in out.collect()} == {*names[1:6], "A.OController.M7()"}


def test_a_change_computes_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: read.add(1) or x).asNondeterministic()
    same = [symbol("A.OController", "Class", "1"), symbol("A.OController.Get()", "Method", "1", "[HttpGet] Get"), symbol("A.Client", "Class", "1", file="src/client.cs"), symbol("A.Client.http", "Field", "1", None, "HttpClient", "src/client.cs"), symbol("A.T", "Class", "1")]
    base, target = (spark.createDataFrame([*same, symbol("A.S", "Class", h)], SYMBOL) for h in "12")
    pairs = [("A.OController.Get()", "A.S"), ("A.OController.Get()", "A.S"), ("A.S", "A.Client.http"), ("A.Client", "A.OController.Get()"), ("A.T", "A.Client"), ("A.T", "A.Far"), ("A.Far", None), (None, "A.S")]
    edges = spark.createDataFrame(pairs, "from_id string, to_id string").select(counted("from_id").alias("from_id"), "to_id")
    out = L.change_model(base, target, edges, spark.createDataFrame([], "path string, content string")).where("section in ('impacted', 'edge', 'api', 'integration') and id is not null")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        ("impacted", "A.OController.Get()", "1"), ("impacted", "A.Client", "2"), ("edge", "A.OController.Get() -> A.S", None), ("edge", "A.S -> A.Client.http", None), ("edge", "A.Client -> A.OController.Get()", None), ("edge", "A.T -> A.Client", None),
        ("api", "A.OController.Get()", "GET /O"), ("integration", "A.Client", "2"),
    ], key=str)
    assert read.value <= len(pairs)


def test_requests_that_ask_the_same_are_searched_once(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, "p", "orders late" if k % 2 else "paid", f"s{k % 3}") for k in range(30)], "chunk_id bigint, project_id string, content string, service string")
    vectors = spark.createDataFrame([], "chunk_id bigint, vector array<double>")
    rows = [(k, 0, "p" if k % 4 else None, None if k == 9 else f"orders {k % 2}", None, None if k == 8 else [f"s{k % 3}"]) for k in range(40)]
    asked = spark.createDataFrame(rows, "request_id bigint, query_ord int, project_id string, text string, vector array<double>, services array<string>")
    sizes, legs = {}, {name: getattr(L.R, name) for name in ("keyword_topk", "dependency_leg")}
    for name, leg in legs.items():
        monkeypatch.setattr(L.R, name, lambda q, *a, n=name, f=leg: (sizes.__setitem__(n, q.count()), f(q, *a))[1])
    out = {tuple(r) for r in L.asked_evidence(asked, chunks, vectors).collect()}
    assert sizes == {"keyword_topk": 4, "dependency_leg": 7}
    monkeypatch.setattr(L.R, "asked_once", lambda q, _, leg: leg(q))
    assert out and out == {tuple(r) for r in L.asked_evidence(asked, chunks, vectors).collect()}


def test_evidence_of_a_change(spark):
    chunks = spark.createDataFrame([(k, "p", t, path, sym) for k, t, path, sym in [(1, "orders are paid late", "src/pay.cs", "Pay"), (2, "nothing", "src/own.cs", None), (3, "late orders", None, "Own"), (4, "orders", "x", "y")]] + [(5, "q", "orders late", "src/pay.cs", "Pay")], "chunk_id bigint, project_id string, content string, path string, symbol string")
    vectors = spark.createDataFrame([], "chunk_id bigint, vector array<double>")
    changes = spark.createDataFrame([(7, "p", "late orders", ["src/own.cs", "src/own.cs"], ["Own", None]), (8, "none", None, [], [])], "change_id bigint, project_id string, summary string, paths array<string>, symbols array<string>")
    out = L.change_risk_evidence(changes, chunks, vectors, selected=2).orderBy("request_id", "rank").collect()
    assert [r.request_id for r in out] == [7] * len(out) and {r.chunk_id for r in out} == {1, 2, 3, 4}
    assert [(r.rank, r.selected, r.content is not None) for r in out] == [(1, True, True), (2, True, True), (3, False, False), (4, False, False)]
    assert out[0].chunk_id == 3 and out[0].query_ord == 0 and out[0].evidence_id == "chunk:3"


def test_names_in_any_case(spark):
    rows = [("b", "p", 1), ("A", "p", 2), ("a", "p", 3), ("a", "p", 4), ("B", "q", 5), (None, "q", 6)]
    out = {r.symbol_id: r.place for r in C.by_name(spark.createDataFrame(rows, "name string, project string, symbol_id int")).collect()}
    assert out == {2: 1, 3: 2, 4: 3, 1: 4, 6: 1, 5: 2}


# ---------------------------------------------------------------- the stream


def lines(path, *docs):
    path.write_text("".join((d if isinstance(d, str) else json.dumps(dict(zip(("document_id", "project_id", "content"), d, strict=True)))) + "\n" for d in docs))


def state(spark, path):
    docs = {r.document_id: (r.project_id, r.content) for r in W.table(spark, path, "documents", G.DOCUMENT).collect()}
    return docs, sorted(((r.id, r.reason) for r in W.rejects(spark, path).collect()), key=str), {(r.batch, r.status): r.n for r in W.ledger(spark, path).collect()}


def test_bad_lines_neither_stop_a_stream_nor_are_lost(spark, tmp_path, monkeypatch):
    folder, path = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()

    def run(apply):
        T.ingest_stream(G.document_stream(spark, str(folder), 1), apply, str(tmp_path / "state")).awaitTermination(120)

    lines(folder / "1.json", (1, "p", "one"), "{broken", (2, "p", "two"), (None, "p", "x"), (3, "", "three"), (4, "p", " "), (1, "p", "one again"))
    run(G.into_store(path))
    assert state(spark, path) == ({1: ("p", "one again"), 2: ("p", "two")}, sorted([(None, "no JSON of a document: {broken"), (None, "no document id"), ("3", "no project"), ("4", "no content")], key=str), {("batch-0", "new"): 2})
    lines(folder / "2.json", (2, "p", "two changed"), (1, "q", "moved"), "[1, 2", (5, "p", "five"))
    kept, calls = W.stored, []

    def failing(df, to, *partitions):
        calls.append(to)
        if len(calls) == 4:
            raise OSError("lost executor")
        kept(df, to, *partitions)

    # The batch fails between its tables, and is run again when the stream is started anew.
    monkeypatch.setattr(W, "stored", failing)
    with pytest.raises(Exception, match="lost executor"):
        run(G.into_store(path))
    monkeypatch.setattr(W, "stored", kept)
    run(G.into_store(path))
    run(G.into_store(path))
    docs, rejects, ledger = state(spark, path)
    assert docs == {1: ("p", "one again"), 2: ("p", "two changed"), 5: ("p", "five")}
    assert len(rejects) == 4 + 2 and ("1", "the document is another project's") in rejects and any(r[1].startswith("no JSON of a document: [1, 2") for r in rejects)
    assert ledger == {("batch-0", "new"): 2, ("batch-1", "new"): 1, ("batch-1", "changed"): 1, ("batch-1", "error"): 1}
    chunks = W.table(spark, path, "chunks", "document_id bigint, position int, chunk string")
    assert sorted((r.document_id, r.chunk) for r in chunks.select(F.col("document_id"), "chunk").collect()) == [(1, "one again"), (2, "two changed"), (5, "five")]
