"""The store, versioned files and rules for arguments: failures, reruns, missing files, and everything that can be wrong."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lanternlake.operators import arguments as A
from lanternlake.operators import sinks as W
from lanternlake.sources import revisions as V

DOCUMENT, CHUNK = "document_id bigint, content string", "document_id bigint, position int, chunk string"


def folder() -> str:
    return tempfile.mkdtemp(prefix="spark-") + "/store"


def state(spark, path):
    return {name: sorted(tuple(r) for r in W.table(spark, path, name, schema).collect()) for name, schema in (("documents", DOCUMENT), ("chunks", CHUNK), ("vectors", DOCUMENT))}


def bring(spark, path, batch, docs, status, **more):
    d = spark.createDataFrame(docs, DOCUMENT)
    chunks = d.selectExpr("document_id", "explode(array(0, 1)) AS position", "concat(content, '-chunk') AS chunk")
    W.ingest(path, batch, spark.createDataFrame(status, "document_id bigint, status string"), d, chunks, d.selectExpr("document_id", "concat('v', content) AS content"), **more)


def expected(docs, vectors=None):
    rows = sorted(docs.items())
    return {"documents": rows, "chunks": sorted((k, p, v + "-chunk") for k, v in rows for p in (0, 1)), "vectors": sorted((k, "v" + v) for k, v in (vectors or docs).items())}


def test_ingestions_replace_and_delete(spark):
    path = folder()
    assert state(spark, path) == {"documents": [], "chunks": [], "vectors": []}
    docs = {k: f"a{k}" for k in range(40)}
    bring(spark, path, "1", list(docs.items()), [(k, "new") for k in docs])
    assert state(spark, path) == expected(docs)
    later = {k: f"b{k}" for k in range(30, 60)}
    status = [(k, "changed" if k < 35 else "skipped" if k < 38 else "error" if k < 40 else "new") for k in later] + [(k, "deleted") for k in (0, 1, 2)] + [(40, "new"), (3, "reembed"), (4, None)]
    for _ in range(2):
        bring(spark, path, "2", [*later.items(), (3, "c3"), (None, "lost")], status)
        now = {k: v for k, v in docs.items() if k > 2} | {k: v for k, v in later.items() if k < 35 or k >= 40}
        assert state(spark, path) == expected(now, now | {3: "c3"})
        left_out = sorted(tuple(r) for r in W.rejects(spark, path).select("kind", "id", "reason").collect() if r.kind == "document")
        assert left_out == [("document", "38", "the document is another project's"), ("document", "39", "the document is another project's")]
        assert W.rejects(spark, path).where("id is null").count() == 4
        assert {(r.batch, r.status): r.n for r in W.ledger(spark, path).collect()} == {("1", "new"): 40, ("2", "changed"): 5, ("2", "skipped"): 3, ("2", "error"): 2, ("2", "new"): 20, ("2", "deleted"): 3, ("2", "reembed"): 1, ("2", None): 1}
    bring(spark, path, "3", [], [(k, "deleted") for k in range(100)])
    assert state(spark, path) == {"documents": [], "chunks": [], "vectors": []}


def test_a_failure_leaves_the_store_as_it_was_and_a_rerun_completes_it(spark, monkeypatch):
    path, docs = folder(), {k: f"a{k}" for k in range(20)}
    bring(spark, path, "1", list(docs.items()), [(k, "new") for k in docs])
    kept, calls = W.stored, []

    def failing(df, to, *partitions):
        calls.append(to)
        if len(calls) == stop:
            raise OSError("disk full")
        kept(df, to, *partitions)

    monkeypatch.setattr(W, "stored", failing)
    later = [(5, "b5"), (50, "b50")]
    status = [(5, "changed"), (50, "new"), (6, "deleted")]
    # Tables are staged first, so a failure there changes nothing.
    for stop in (1, 2, 3):
        calls.clear()
        with pytest.raises(OSError):
            bring(spark, path, "2", later, status)
        assert state(spark, path) == expected(docs)
    # One between tables is mended by the next run.
    for stop in (5, 6):
        calls.clear()
        with pytest.raises(OSError):
            bring(spark, path, "2", later, status)
    stop = 0
    bring(spark, path, "2", later, status)
    assert state(spark, path) == expected({k: v for k, v in docs.items() if k != 6} | dict(later))


def test_a_failure_while_folders_are_moved_is_mended_by_the_next_run(spark, monkeypatch):
    path, docs = folder(), {k: f"a{k}" for k in range(200)}
    bring(spark, path, "1", list(docs.items()), [(k, "new") for k in docs])
    kept = W.moved

    def failing(spark, at, to):
        # The first folder's old rows are gone, the new ones aren't there yet.
        first = min(x for x in os.listdir(at) if "=" in x)
        shutil.rmtree(f"{to}/{first}")
        raise OSError("no network")

    later, status = [(k, f"b{k}") for k in range(100)], [(k, "changed") for k in range(100)]
    monkeypatch.setattr(W, "moved", failing)
    with pytest.raises(OSError):
        bring(spark, path, "2", later, status)
    monkeypatch.setattr(W, "moved", kept)
    bring(spark, path, "2", later, status)
    assert state(spark, path) == expected(docs | dict(later))


def test_texts_are_written_once_and_shuffled_once(spark, monkeypatch):
    path, kept, written = folder(), W.stored, []
    monkeypatch.setattr(W, "stored", lambda df, to, *partitions: (written.append((to.removeprefix(path), df._jdf.queryExecution().executedPlan().toString())), kept(df, to, *partitions)))
    bring(spark, path, "1", [(1, "a"), (2, "b")], [(1, "new"), (2, "new")])
    tables = [(to, plan) for to, plan in written if "content" in plan and "rejects" not in to]
    assert [to for to, _ in tables] == [f"/_staged/1/{name}" for name in ("documents", "chunks", "vectors")]
    assert not any("REPARTITION_BY" in plan for _, plan in tables)
    written.clear()
    bring(spark, path, "1", [(1, "a"), (2, "b")], [(1, "skipped"), (2, "skipped")])
    assert not any("Join" in plan for to, plan in written if "_staged" in to) and state(spark, path) == expected({1: "a", 2: "b"})


def test_json_of_runs_is_replaced_by_batch(spark):
    path = folder()
    for rows, batch in (([("r1", 1), ("r2", None)], "a"), ([("r3", 3)], "b"), ([("r1", 5)], "a")):
        W.save_json(spark.createDataFrame(rows, "run_id string, n int"), path, "run_id", batch)
    assert sorted((r.key, r.json, r.batch) for r in W.load_json(spark, path).collect()) == [("r1", '{"n":5}', "a"), ("r3", '{"n":3}', "b")]


# ---------------------------------------------------------------- versioned files


@pytest.fixture
def tree(spark, tmp_path):
    files = {"base": {"src/a.cs": "a0", "src/gone.cs": "g0", "docs/x.md": "x0", "src/bin/out.cs": "no"}, "v2": {"src/a.cs": "a1", "src/new.cs": "ü漢\n"}, V.WORKING_TREE: {"src/a.cs": "a2", "src/gone.cs": "g2", "src/own.cs": "o", "deep/er/f.cs": ""}}
    for rev, own in files.items():
        for path, content in own.items():
            (tmp_path / rev / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rev / path).write_text(content)
    (tmp_path / "v2/src/odd.cs").write_bytes(b"\xff\xfe\x00")
    V.register(spark)
    return str(tmp_path)


def test_a_change_between_revisions(spark, tree):
    files = spark.createDataFrame([(p,) for p in ("src/a.cs", "src/gone.cs", "src/new.cs", "src/odd.cs", "src/none.cs", "src/a.cs", None)], "path string")
    out = {r.path: (r.base_content, r.target_content, r.warning) for r in V.resolved_change(spark, tree, files, "base", "v2").collect()}
    assert out == {"src/a.cs": ("a0", "a1", None), "src/gone.cs": ("g0", None, None), "src/new.cs": (None, "ü漢\n", None), "src/odd.cs": (None, None, "src/odd.cs is no text"), "src/none.cs": (None, None, "No content for src/none.cs")}
    now = {r.path: (r.base_content, r.target_content) for r in V.resolved_change(spark, tree, files, "base").collect()}
    assert now["src/a.cs"] == ("a0", "a2") and now["src/gone.cs"] == ("g0", "g2")
    change = V.resolved_change(spark, tree, files, "base", "v2")
    assert {r.path: r.content for r in V.state_after(spark, tree, change).collect()} == {"src/a.cs": "a1", "src/new.cs": "ü漢\n", "src/own.cs": "o", "deep/er/f.cs": ""}
    assert V.revision(spark, tree, "no such revision").collect() == [] and V.revision(spark, tree + "/nowhere", "base").collect() == []


def test_conditions_are_pushed_into_the_source(tree):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    def names(*filters):
        reader = V.RevisionReader(tree)
        left = list(reader.pushFilters(list(filters)))
        return [x for p in reader.partitions() for x in p.names], left

    every, _ = names()
    assert len(every) == 10 and ("base", "src/bin/out.cs") not in every
    assert names(EqualTo(("rev",), "base"))[0] == [("base", "docs/x.md"), ("base", "src/a.cs"), ("base", "src/gone.cs")]
    assert names(EqualTo(("rev",), "v2"), In(("path",), ("src/a.cs", "src/none.cs")))[0] == [("v2", "src/a.cs")]
    assert names(StringStartsWith(("path",), "docs/"))[0] == [("base", "docs/x.md")]
    assert names(EqualTo(("rev",), "base"), EqualTo(("rev",), "v2"))[0] == []
    other = GreaterThan(("path",), "s")
    assert names(other)[1] == [other]


def test_files_are_written_and_read_back(spark, tmp_path):
    V.register(spark)
    root = str(tmp_path / "root")
    rows = [("r1", f"d{k % 3}/f{k}.txt", f"text {k}\n") for k in range(500)] + [("r2", "one.txt", "")]
    df = spark.createDataFrame(rows, "rev string, path string, content string")
    for _ in range(2):
        df.write.format("revisions").mode("append").save(root)
    found = spark.read.format("revisions").load(root)
    assert sorted((r.rev, r.path, r.content) for r in found.collect()) == sorted(rows) and found.rdd.getNumPartitions() == 3
    assert not [p for p in Path(root).rglob("*.part")]
    for bad in (("r", "../x", "a"), ("r", None, "a"), ("r", "/x", "a"), ("r", "x", None)):
        with pytest.raises(Exception, match="file needs|must lie"):
            spark.createDataFrame([bad], "rev string, path string, content string").write.format("revisions").mode("append").save(root)


# ---------------------------------------------------------------- arguments


def test_rules(spark):
    known = A.rules(
        spark, ("t", "id", "uuid", True), ("t", "name", "identifier", False, 2.0, 5.0), ("t", "n", "integer", False, -1.0, 10.0), ("t", "r", "number", False, 0.0, 1.0), ("t", "b", "boolean", False), ("t", "l", "array", False, 1.0, 2.0), ("t", "o", "object", False), ("t", "e", "string", False, None, None, ["low", "high"]), ("other", "x", "string", True),
    )
    uuid = "12345678-1234-1234-1234-123456789abc"
    cases = [
        ({"id": uuid}, []), ({"id": uuid.replace("-", "")}, []), ({"id": "{" + uuid + "}"}, []), ({"id": uuid[:-1]}, ["id:not-uuid"]), ({}, ["id:missing"]), ({"id": None}, ["id:missing"]), ({"id": 5}, ["id:type"]), ({"id": " "}, ["id:not-uuid"]),
        ({"id": uuid, "name": " ab "}, []), ({"id": uuid, "name": "a"}, ["name:below"]), ({"id": uuid, "name": "abcdef"}, ["name:above"]), ({"id": uuid, "name": "  "}, ["name:blank"]), ({"id": uuid, "name": "a..b"}, ["name:unsafe"]), ({"id": uuid, "name": "HTTPx"}, ["name:unsafe"]),
        ({"id": uuid, "n": 10}, []), ({"id": uuid, "n": 11}, ["n:above"]), ({"id": uuid, "n": -2}, ["n:below"]), ({"id": uuid, "n": 1.5}, ["n:type"]), ({"id": uuid, "n": "1"}, ["n:type"]), ({"id": uuid, "n": True}, ["n:type"]),
        ({"id": uuid, "r": 1}, []), ({"id": uuid, "r": 0.5}, []), ({"id": uuid, "r": 1.01}, ["r:above"]), ({"id": uuid, "r": 1e300}, ["r:above"]), ({"id": uuid, "b": 1}, ["b:type"]), ({"id": uuid, "b": False}, []),
        ({"id": uuid, "l": []}, ["l:below"]), ({"id": uuid, "l": [1, "a"]}, []), ({"id": uuid, "l": [1, 2, 3]}, ["l:above"]), ({"id": uuid, "o": {}}, []), ({"id": uuid, "o": []}, ["o:type"]), ({"id": uuid, "e": "low"}, []), ({"id": uuid, "e": "mid"}, ["e:not-allowed"]),
        ({"id": 1, "e": 2, "unknown": 3}, ["e:type", "id:type"]), ([], ["not-object"]), ("text", ["not-object"]), (7, ["not-object"]), (None, ["not-object"]),
    ]
    rows = [(k, "t", json.dumps(value)) for k, (value, _) in enumerate(cases)] + [(100, "t", "{"), (101, "t", None), (102, "t", ""), (103, "unknown tool", "{}"), (104, None, "{}"), (105, "other", '{"x": "y"}'), (105, "other", '{"x": "y"}')]
    df = spark.createDataFrame(rows, "k int, subject string, json string").withColumn("errors_", F.lit(1))
    out = A.checked(df, known)
    found = [(r.k, r.errors) for r in out.collect()]
    wanted = [(k, e) for k, (_, e) in enumerate(cases)] + [(100, ["not-json"]), (101, ["not-json"]), (102, ["not-json"]), (103, None), (104, None), (105, []), (105, [])]
    assert sorted(found, key=repr) == sorted(wanted, key=repr) and out.columns == [*df.columns, "errors"]
    values = df.select("k", A.integer_argument(F.col("json"), "n", 4).alias("n")).collect()
    assert {r.n for r in values if r.k >= 100} == {4} and [r.n for r in values if r.k in (14, 17, 18, 19)] == [10, 4, 4, 4]


def test_raw_data(spark):
    df = spark.createDataFrame([(1, None), (2, '{"a": {"b": [1]}}'), (3, "{"), (4, "null"), (5, "")], "k int, raw string")
    out = {r.k: (r.valid, r.j) for r in df.select("k", A.raw_data(F.col("raw")).alias("x")).select("k", "x.valid", F.to_json("x.data").alias("j")).collect()}
    assert out == {1: (True, None), 2: (True, '{"a":{"b":[1]}}'), 3: (False, None), 4: (True, "null"), 5: (False, None)}
