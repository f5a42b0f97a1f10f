"""Values of readers, functions and small operators on hand-made rows."""

from __future__ import annotations

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from lanternlake.functions import text as X
from lanternlake.functions import vector as V
from lanternlake.operators import change as C
from lanternlake.operators import evaluation as E
from lanternlake.operators import evidence as P
from lanternlake.operators import incidents as N
from lanternlake.operators import retrieval as R
from lanternlake.operators import runs as U
from lanternlake.sources import tables as S


def of(spark, values, column, kind="string"):
    """A column expression's value for each of some values x, in their order."""
    df = spark.createDataFrame(list(enumerate(values)), f"n int, x {kind}")
    return [r.y for r in df.select("n", column(F.col("x")).alias("y")).orderBy("n").collect()]


# ---------------------------------------------------------------- readers


def test_code_files_leave_build_output_out(spark, tmp_path):
    for path, text in {"src/A.cs": "class A {}\r\n", "src/deep/B.cs": "\n", "src/empty.cs": "", "bin/C.cs": "x", "src/obj/D.cs": "x", "note.md": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text.encode())
    out = {r.path: (r.id, r.project_id, r.document_type, r.title, r.content) for r in S.code_files(spark, str(tmp_path), "p").collect()}
    assert out == {"src/A.cs": ("p:code:src/A.cs", "p", "SourceCode", "A.cs", "class A {}\r\n"), "src/deep/B.cs": ("p:code:src/deep/B.cs", "p", "SourceCode", "B.cs", "\n")}


def test_markdown_files_take_their_title_from_the_first_line(spark, tmp_path):
    (tmp_path / "one.md").write_text("## A title \nbody")
    (tmp_path / "two.md").write_text("no mark")
    (tmp_path / "three.txt").write_text("x")
    out = {r.path: (r.id, r.document_type, r.title, r.content) for r in S.markdown_files(spark, str(tmp_path), "p", "Runbook").collect()}
    assert out == {"one.md": ("p:runbook:one", "Runbook", "A title", "## A title \nbody"), "two.md": ("p:runbook:two", "Runbook", "no mark", "no mark")}


def test_golden_cases_are_trimmed(spark, tmp_path):
    cases = [{"id": " c1 ", "query": " why ", "expected_evidence": [" a ", "", "b"], "difficulty": " "}, {"id": "c2", "query": " "}, {"query": "no id"}, {"id": "c3", "query": "q", "archetype": "x"}]
    (tmp_path / "golden.json").write_text(json.dumps({"schema_version": "7", "cases": cases}, indent=1))
    out = {r.id: (r.version, r.query, r.expected_evidence, r.archetype, r.difficulty) for r in S.golden_cases(spark, str(tmp_path / "golden.json")).collect()}
    assert out == {"c1": ("7", "why", ["a", "b"], None, None), "c3": ("7", "q", [], "x", None)}


def test_baseline_reports(spark, tmp_path):
    assert S.baseline_report(spark, str(tmp_path / "none.json")).collect() == []
    (tmp_path / "old.json").write_text('{"leg": "vector", "k": 5, "metric": "mrr", "value": 0.5}\nnot json\n{"k": 5}\n')
    assert [tuple(r) for r in S.baseline_report(spark, str(tmp_path / "old.json")).collect()] == [("vector", 5, "mrr", 0.5)]


def test_scoped_and_live_rows(spark):
    df = spark.createDataFrame([(1, "p", None), (2, "q", None), (3, "p", "2024")], "id int, project_id string, deleted_at string")
    assert [r.id for r in S.live(S.scoped(df, "p")).collect()] == [1]


def test_audit_entries_are_appended(spark, tmp_path):
    entries = spark.createDataFrame([(1, "login")], "id int, action string")
    for _ in range(2):
        N.audit_append(entries, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


# ---------------------------------------------------------------- functions


def test_names_and_paths(spark):
    assert of(spark, ["src/Shop/A.cs", "src/A.cs", "lib/x/A.cs", "A.cs", "", None], X.project_of) == ["Shop", "src", "lib", None, None, None]
    assert of(spark, ["Crème  Brûlée_1.x", "---", "ÀÉ", "漢字", None, "a" * 200], X.slugify) == ["creme-brulee-1-x", "project", "ae", "project", None, "a" * 140]
    assert of(spark, ["ok name", "a/b", "..", "file:x", "HTTPS", "a;b", "Run(int x)"], X.safe_identifier) == [True, False, False, False, False, False, True]


def test_declarations(spark):
    text = "[A]\npublic int Run(\n  int x)\n{\n  return x;\n}"
    assert of(spark, [text, "int X => 1;", "\n".join(map(str, range(20)))], X.declaration_header) == ["[A]\npublic int Run(\n  int x)", "int X => 1;", "\n".join(map(str, range(14)))]
    assert of(spark, [["CancellationToken t", "Order o", "int x"], ["CancellationToken t"], [], None], X.request_type, "array<string>") == ["Order o", None, None, None]
    assert of(spark, ["Task<List<Order>>", "Task", "int", None], X.response_type) == ["List<Order>", "Task", "int", None]
    hints = of(spark, ['a("/x", "v1/y", "Default TIMEOUT", "will Retry", "/z")', None], X.literal_hints)
    assert [tuple(h) for h in hints] == [(["/x", "v1/y", "/z"], "Default TIMEOUT", "will Retry"), ([], None, None)]


def test_diff_previews(spark):
    cases = [("a\nb\nc", "a\nx\nc"), ("a\nb", "a\nb"), ("a\r\nb", "a\nb"), ("a\nb", "a\nb\nc"), ("a\na", "a"), (None, "new"), ("old", None), (None, None), ("", "x")]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, a string, b string")
    out = [r.d for r in df.select("n", X.diff_preview(F.col("a"), F.col("b")).alias("d")).orderBy("n").collect()]
    assert out == ["@@ -2,1 +2,1 @@\n-b\n+x", None, "@@ -3,0 +3,0 @@", "@@ -3,0 +3,1 @@\n+c", "@@ -2,1 +2,0 @@\n-a", "new", "old", None, "@@ -1,1 +1,1 @@\n-\n+x"]


def test_change_identifiers(spark):
    df = spark.createDataFrame([(0, None, None), (1, "a", "b"), (2, None, "b"), (3, "a", None)], "n int, a string, b string")
    assert [r.c for r in df.select("n", C.change_identifier(F.col("a"), F.col("b")).alias("c")).orderBy("n").collect()] == ["working-tree", "a..b", "HEAD..b", "a..working-tree"]


def test_costs(spark):
    df = spark.createDataFrame([(1_000_000, 500_000), (3, None)], "i long, o long")
    assert [r.c for r in df.select(P.token_cost(F.col("i"), F.col("o"), 2.0, 4.0).alias("c")).collect()] == [4.0, None]
    assert df.select(P.token_cost(F.col("i"), F.col("o"), None, 4.0).alias("c")).first().c is None


def test_evidence_ids_in_rendered_texts(spark):
    from lanternlake.operators import workflow as W

    text = "- chunk:1\n-  symbol:X.Y \n- dependency:a -> b\r\n- dependency:a - b\n chunk:2\n- other:3\n- chunk:\n- chunk:a b\n- note chunk:4\n-chunk:5\n- change:src/a.cs"
    assert of(spark, [text, "", None], W.evidence_ids_in) == [["chunk:1", "symbol:X.Y", "dependency:a -> b", "change:src/a.cs"], [], []]


def test_providers(spark):
    out = of(spark, ["two words", ""], lambda c: V.PROVIDERS["hashed-words"](c, 16), "string")
    assert all(len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-9 for v in out)
    assert V.model_version("hashed-words", 16) != V.model_version("hashed-words", 32)


# ---------------------------------------------------------------- small operators


def test_files_of_a_change(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "file_path string") for xs in (["x", "y", None], ["y", "z"]))
    assert sorted(r.file_path for r in C.dependency_files(a, b).collect()) == ["x", "y", "z"]


def test_stage_durations(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'search', 'started', timestamp'2024-01-01 00:00:01'), (1, 'search', 'completed', timestamp'2024-01-01 00:00:03.5'), (1, 'write', 'started', timestamp'2024-01-01 00:00:04') AS t(run_id, stage, event, ts)")
    assert {(r.run_id, r.stage): r.ms for r in U.stage_durations(df).collect()} == {(1, "search"): 2500, (1, "write"): None}


def test_queries_of_incidents_and_changes(spark):
    i = spark.createDataFrame([(1, "Down", ["a", "a", " ", "b", "c", "d", "e", "f"], "svc"), (2, " ", [], None)], "incident_id int, title string, symptoms array<string>, service string")
    assert sorted((r.incident_id, r.query_ord, r.text) for r in P.incident_queries(i).collect()) == [(1, k, t) for k, t in enumerate(["Down", "a", "b", "c", "d", "svc"])]
    c = spark.createDataFrame([(1, "s" * 2500, [f"d/f{k}.cs" for k in range(9)] + ["e/f0.cs"], ["S1", "S1", "S2"])], "change_id int, summary string, paths array<string>, symbols array<string>")
    assert [r.text for r in P.change_queries(c).orderBy("query_ord").collect()] == ["s" * 2000, "f0.cs", "f1.cs", "f2.cs", "f3.cs", "f4.cs", "S1", "S2"]


def test_selection_and_checks(spark):
    found = spark.createDataFrame([(1, "x" * 20), (3, "y")], "rank int, content string")
    assert [(r.selected, r.content) for r in P.selection_trace(found, 2, 5).orderBy("rank").collect()] == [(True, "xxxxx"), (False, "y")]
    results = spark.createDataFrame([(1, "HIGH", 3), (2, "odd", None), (3, "LOW", 9)], "id int, risk string, n int")
    out = P.structured_violations(results, {"risk": F.col("risk").isin("LOW", "HIGH"), "n": F.col("n").between(0, 5)}, "id").collect()
    assert {r.id: r.errors for r in out} == {2: ["risk", "n"], 3: ["n"]}


def test_counts_of_an_evaluation(spark):
    gold, cited = (spark.createDataFrame(rows, "case_id int, source_key string") for rows in ([(1, "A.md"), (1, "b.md"), (2, "c.md")], [(1, "a.MD"), (1, "a.md"), (2, "x")]))
    assert {r.case_id: (r.covered, r.n_gold) for r in E.gold_coverage(cited, gold).collect()} == {1: (1, 2), 2: (0, 1)}
    exact = {(r.case_id, r.source_key): (r.cited_key, r.tier) for r in E.matched_sources(cited, gold.union(spark.createDataFrame([(1, "a.md")], gold.schema))).collect()}
    assert exact == {(1, "A.md"): ("a.MD", "case-blind"), (1, "a.md"): ("a.md", "exact"), (1, "b.md"): (None, None), (2, "c.md"): (None, None)}
    cases = spark.createDataFrame([(1, True, False), (2, True, None), (3, False, True)], "case_id int, valid boolean, grounded boolean")
    one = E.outcome_counts(cases, "valid", "grounded").first().asDict()
    assert sorted(one.values()) == [1, 2, 3]
    skipped = spark.createDataFrame([("r",), ("r",), ("s",)], "reason string")
    assert {tuple(r) for r in E.skip_reasons(skipped).collect()} == {("r", 2), ("s", 1)}


def test_a_report_in_markdown(spark):
    summary = spark.createDataFrame([("vector", 5, 2, 0.5, 0.25, 1.0, 1.0)], "leg string, k int, n_cases long, recall double, precision double, mrr double, hit_rate double")
    text = E.markdown_report(summary)
    assert text.count("\n") >= 3 and "| vector | 5 |" in text


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame([(1, "p", "red apple", "a/x.cs", "X", "s1"), (2, "p", "green apple apple", "a/y.cs", "Y", "s2"), (3, "p", "pear", None, None, "s1"), (4, "q", "red apple", "a/x.cs", "X", "s1")], "chunk_id bigint, project_id string, content string, path string, symbol string, service string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [1.0, 0.0])], "chunk_id bigint, vector array<double>")
    queries = spark.createDataFrame([(1, "p", "apple", [1.0, 0.0], ["a/y.cs", " "], ["X"], None), (2, "p", "none", None, None, None, ["s1"])], "query_id bigint, project_id string, text string, vector array<double>, paths array<string>, symbols array<string>, services array<string>")
    return queries, chunks, vectors


def test_single_strategies_and_all_terms(corpus):
    queries, chunks, vectors = corpus

    def hits(strategy, q=queries):
        return {(r.query_id, r.rank, r.chunk_id) for r in R.search(q, chunks, vectors, strategy).collect()}

    assert hits("vector") == {(1, 1, 1), (1, 2, 3), (1, 3, 2)}
    assert hits("keyword") == {(1, 1, 2), (1, 2, 1)}
    # Paths, symbols and services are one leg, by id; blank terms ask for nothing.
    assert hits("dependency") == {(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 3)}
    assert {(q, c) for q, _, c in hits("hybrid")} == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 3)}
    assert hits("dependency", queries.drop("paths", "symbols", "services")) == set()
    with pytest.raises(ValueError):
        R.search(queries, chunks, vectors, "other")


def test_gold_by_passages(spark):
    chunks = spark.createDataFrame([("a", "p", "xx one two three four five six seven yy"), ("b", "p", "one two three four five six seventh"), ("c", "q", "one two three four five six seven"), ("d", "p", "short text here"), ("e", "p", None)], "source_key string, project_id string, content string")
    cases = spark.createDataFrame([(1, "p", "one two three four five six seven"), (2, "p", "t text her"), (3, "p", "word"), (4, "p", None), (5, "p", "ne two three four five six sev"), (6, "p", "one two  three four five six seven")], "case_id int, project_id string, text string")
    assert {tuple(r) for r in E.passage_gold(cases, chunks).collect()} == {(1, "a"), (1, "b"), (2, "d"), (5, "a"), (5, "b")}


def test_gold_in_a_long_text_takes_the_text_apart_once(spark):
    # 40,000 words: taken apart for each word, or carried with each, they are tens of thousands of times the text.
    words = [f"w{i}" for i in range(40_000)]
    chunks = spark.createDataFrame([("a", "p", " ".join(words)), (None, "p", " ".join(words[:20])), ("b", "q", " ".join(words))], "source_key string, project_id string, content string")
    cases = spark.createDataFrame([(1, "p", " ".join(words[30_000:30_010])), (2, "p", "w3 w4 w5 w6"), (3, "p", "w3 w5 w4 w6 w7 w8 w9")], "case_id int, project_id string, text string")
    began = time.perf_counter()
    assert {tuple(r) for r in E.passage_gold(cases, chunks).collect()} == {(1, "a"), (2, "a"), (2, None)}
    assert time.perf_counter() - began < 30


def test_keywords_are_counted_within_chunks_before_they_meet_queries(spark):
    chunks = spark.createDataFrame([(1, "p", "red red blue"), (1, "p", "red green"), (2, "p", "blue Blue"), (3, "q", "red"), (4, "p", None), (5, None, "red")], "chunk_id bigint, project_id string, content string")
    queries = spark.createDataFrame([(1, "p", "red blue"), (2, "p", "blue x none"), (2, "p", "blue x none"), (3, "p", None), (4, "q", "red, RED")], "query_id bigint, project_id string, text string")
    out = R.keyword_topk(queries, chunks)
    weight = lambda n: 0.1 * sum(1 / j**2 for j in range(1, n + 1)) / 1.64493406685
    # The rows of a repeated chunk id count together, those of a repeated query id twice.
    want = {(1, 1): (weight(3) + weight(1)) / 2, (1, 2): weight(2) / 2, (2, 1): weight(2) / 2, (2, 2): weight(4) / 2, (4, 3): weight(1)}
    assert {(r.query_id, r.chunk_id): r.score for r in out.collect()} == {k: round(v, 6) for k, v in want.items()}
    # No shuffle deals out each query's hits: words go once, by chunk.
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", out._jdf.queryExecution().executedPlan().toString())
    assert dealt and not any("query_id" in x and "chunk_id" in x for x in dealt)
