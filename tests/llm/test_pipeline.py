"""The pipeline: each stage against a plain version on what its predecessor kept."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from lanternlake.llm import mixing, queries_toxicity, toxicity
from tests.llm.test_native import WORD
from tests.llm.test_near_duplicates import plain_near
from tests.llm.test_repeats import covered
from tests.llm.test_tokens import library, plain  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    from lanternlake.llm.common import saved, table

    out = [table(spark, sf_dir, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], sf_dir), name))
    return [[r.asDict() for r in x.collect()] for x in out], [x.columns for x in out]


def test_stages_return_the_columns_of_documents(stages):
    _, columns = stages
    assert all(c == columns[0] for c in columns[:-1]) and len(corpus_pipeline.STAGES) == 5


def test_toxic_documents_go(spark, sf_dir, stages):
    (docs, clean, *_), _ = stages
    scored = toxicity.Scored(queries_toxicity.fitted(spark, sf_dir))
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in docs if scored.score(r["text"]) < 0.5)


def test_one_of_each_group_stays(stages):
    (_, clean, single, *_), _ = stages
    kept = {r[0] for r in plain_near([(r["doc_id"], r["text"]) for r in clean], 5, 80) if r[3]}
    assert {r["doc_id"] for r in single} == kept


def test_repeats_are_cut(stages):
    (_, _, single, cut, *_), _ = stages
    after = {r["doc_id"]: r for r in cut}
    assert len(after) == len(single)
    data = [(r["text"] or "").encode() for r in single]
    for r, x, gone in zip(single, data, covered(data, 400), strict=True):
        expected = bytes(b for b, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else r["text"]
        assert after[r["doc_id"]]["text"] == expected
        assert after[r["doc_id"]]["n_chars"] == (None if expected is None else len(expected))


def test_sources_are_mixed(spark, stages):
    (_, _, _, cut, mixed, _), _ = stages
    size = {}
    for r in cut:
        size[r["source"]] = size.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    got = {}
    for r in mixed:
        got[r["source"]] = got.get(r["source"], 0) + len(WORD.findall(r["text"]))
    df = spark.createDataFrame([(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in cut], "doc_id bigint, source string, size bigint")
    target = {r.source: r.target for r in mixing.mix(df).select("source", "target").distinct().collect()}
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3
    assert all(abs(got.get(s, 0) - t) <= 1 and t <= 2 * size[s] + 1e-6 for s, t in target.items())


def test_all_is_encoded(stages, library):  # noqa: F811
    (*_, mixed, encoded), _ = stages
    assert sorted((tuple(r.values()) for r in encoded), key=repr) == plain(library, [(r["doc_id"], r["text"]) for r in mixed])


ODD = [(1, "word " * 200, "en", "a", 1000), (1, "word " * 200, "en", "a", 1000), (1, "other words here", "en", None, 16), (None, "word " * 200, "en", "a", 1000), (None, "alone with no id", None, "b", None), (2, None, None, "a", None), (2, None, None, "a", None), (3, "", "en", "b", 0), (4, " \n\t ", "en", None, 4), (5, "é" * 3000, "fr", "c", 3000), (6, "one", "en", "c", 3)]


def test_stages_over_awkward_rows(spark, sf_dir):
    """Null and repeated ids, texts and sources, blanks, and rows that are equal in all."""
    from lanternlake.llm.common import saved

    given = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    scored = toxicity.Scored(queries_toxicity.fitted(spark, sf_dir))
    clean = corpus_pipeline.drop_toxic(spark, given, sf_dir).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in clean), key=key) == sorted(((i, t) for i, t, *_ in ODD if scored.score(t) < 0.5), key=key)
    assert sum(not (r.text or "").strip() for r in clean) == 4
    docs, kept = given, {}
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = saved(stage(spark, docs, sf_dir), name)
        kept[name] = [r.asDict() for r in docs.collect()]
    texts = lambda name: sorted((str(r["doc_id"]), r["text"]) for r in kept[name] if r["text"] and r["text"].strip())
    # One of the copies stays, under an id that is not null; what has no word stays as it is.
    assert texts("minhash_near_dedup") == sorted([("1", "word " * 200), ("1", "other words here"), ("None", "alone with no id"), ("5", "é" * 3000), ("6", "one")])
    assert sum(not (r["text"] or "").strip() for r in kept["minhash_near_dedup"]) == 4
    # Each remaining copy of 400 bytes within one text goes, too.
    assert {len(r["text"] or "") for r in kept["suffix_array_dedup"] if r["doc_id"] == 5} == {0}
    assert len(kept["suffix_array_dedup"]) == len(kept["minhash_near_dedup"])
    assert all(WORD.findall(r["text"]) for r in kept["mix_sources"]) and len(kept["bpe_encode"]) == len(kept["mix_sources"])


def test_stages_over_an_empty_table(spark, sf_dir, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []


def test_registered(spark):
    names = entry_point.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
