"""Layouts by fingerprint, reversible formatting, masks, and conversations of any length."""

from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternlake.llm import chat, registry

BITS = st.lists(st.sampled_from(["\\", "#", "##", "###", "### ", "</turn>", "</turn>\n", "<", "/turn>", ": ", ":", "assistant", "\n", " ", "é", "\U0001f600", "a"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), BITS), BITS), max_size=6))
def test_what_is_formatted_reads_back(turns):
    text, spans = chat.formatted(turns)
    assert chat.read_turns(text) == turns
    assert [chat.unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    # Parts put together are the whole.
    assert "".join(chat.formatted([t])[0] for t in turns) == text


def test_no_turn_is_an_error():
    with pytest.raises(ValueError):
        chat.read_turns("### user: no end")


RECORDS = [
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"completion": "c", "prompt": "p", "system": "s"}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "more", "output": None}, "instruction", [("user", "i\n\nmore"), ("assistant", "")]),
    ({"instruction": "i", "input": "", "output": "o", "system": None}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": 7}]}, "messages", [("user", "a"), ("tool", "7")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message-parts", [("user", "ab")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}, "from-value", [("user", "a"), ("assistant", "")]),
    ({"question": "q", "answer": "a", "meta": {"lang": "en", "tags": ["x"]}}, "question", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "p", "response": "r", "id": 4}, "prompt-response", [("user", "p"), ("assistant", "r")]),
    ({"title": "t"}, None, []),
    ([1], None, []),
    (None, None, []),
]


def test_layouts_by_fingerprint(spark):
    rows = [(k if k % 5 else None, json.dumps(r) if r is not None else None) for k, (r, _, _) in enumerate(RECORDS)] + [(99, "{no json"), (98, "")]
    df = spark.createDataFrame(rows, "conv_id bigint, record string").withColumn("layout", F.lit("clash")).withColumn("formatted", F.lit(1))
    out = chat.format_records(df).collect()
    assert len(out) == len(rows)
    found = sorted((r.conv_id is not None, r.conv_id or 0, r.layout or "", r.n_turns, r.formatted) for r in out)
    assert found == sorted((k is not None, k or 0, layout or "", len(turns), chat.formatted(turns)[0]) for (k, _), (_, layout, turns) in zip(rows, [*RECORDS, (0, None, []), (0, None, [])], strict=True))
    marks = [chat.fingerprint(chat.paths(r)) for r, _, _ in RECORDS if isinstance(r, dict)]
    # The order of fields and the values don't matter, the paths do.
    assert len(set(marks)) == len(marks)
    assert chat.fingerprint(chat.paths({"b": 1, "a": [{"c": None}]})) == chat.fingerprint(chat.paths({"a": [{"c": "x"}, {"c": 2}], "b": {}}))
    assert chat.paths({"a.b": {"c": []}}) != chat.paths({"a": {"b": {"c": []}}})


def test_struct_records(spark):
    df = spark.sql("SELECT 1L AS conv_id, named_struct('prompt', 'a', 'completion', 'b') AS record")
    assert chat.format_records(df).first().formatted == "### user: a</turn>\n### assistant: b</turn>\n"


def digests(rows: list[tuple]) -> dict:
    """From rows (id, turn, role, text)."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == key))
        learned = "".join(t for *_, role, t in own if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[key] = (len(own), sha("".join(f"{r}\n{t}\n" for *_, r, t in own)), len(learned), sha(learned), len(chat.formatted([(r, t) for *_, r, t in own])[0]))
    return out


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "### x </turn>\n\\"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, None, "user", ""), (3, 0, None, "x"), (4, 0, "human", "h"), (5, 0, "us:er", "y" * 300_000), (5, 1, "assistant", "ü" * 2_000_000), (5, 2, "assistant", "end"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    rows += [(7, k, "assistant" if k % 2 else "user", f"turn {k} \\") for k in range(1500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("at", F.lit(1)).withColumn("record", F.lit("r")).repartition(9)
    records = chat.records_of(df)
    assert records.where("conv_id = 7").count() > 20
    out = chat.read_back(chat.format_records(records, order_col="at")).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in out} == digests(rows)
    assert len(out) == len({r[0] for r in rows})


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_records(chat.records_of(none), order_col="at")).collect() == []


def test_query_equals_its_sql_and_meets_several_layouts(spark, sf_dir, same):
    assert same(registry.QUERIES["op13_chat_format"](spark, sf_dir), registry.SQL["op13_chat_format"])
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert {r.layout for r in chat.format_records(chat.records_of(turns), order_col="at").select("layout").distinct().collect()} >= {"prompt", "messages", "from-value"}
