"""Toxicity: held-out accuracy, misspellings, determinism, awkward rows."""

from __future__ import annotations

import zlib

import pytest

from lanternlake.llm import queries_toxicity, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return queries_toxicity.fitted(spark, SF)


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_rows_are_told_apart(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = queries_toxicity.op3_toxicity(spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in out if r.held_out and labels.get(r.doc_id) is not None]
    # Nearly half of the toxic labels are on texts without any of the words that mark the others.
    assert auc(held) > 0.88
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.9
    assert sum(s >= 0.5 for s, y in held if not y) / sum(not y for _, y in held) < 0.06


def test_repeated_ids_are_fitted_once(spark):
    rows = [(i, "fine words here" if i % 2 else "vile words here") for i in range(20)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(20)], "doc_id bigint, toxic int")
    one = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    many = toxicity.fit(spark.createDataFrame(rows * 30, "doc_id bigint, text string"), labels)
    assert (one.weight == many.weight).all()


def test_awkward_rows(spark, model, odd, empty):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "\n\t")], "doc_id bigint, text string")
    out = toxicity.score(df, model).collect()
    assert len(out) == 4 and len({r.score for r in out}) == 1
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.keep_clean(df, model).count() == 4


def test_one_class_and_no_labels(spark, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.fit(empty, none).bias == 0
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, None), (None, 1), (9, 1), (2, 7)], "doc_id bigint, toxic int")
    m = toxicity.fit(docs, labels)
    assert all(r.predicted == 0 for r in toxicity.score(docs, m).collect())


def test_misspellings_share_vectors():
    bad = ["you are a horrible scumbag", "what a horrible scumbag he is", "scumbag and horrible"] * 20
    good = ["you are a wonderful neighbour", "what a lovely garden he has", "bread and butter"] * 20
    m = toxicity.train(bad + good, [1] * 60 + [0] * 60, toxicity.Settings(prior=1.0))
    s = toxicity.Scored(m)
    assert s.score("scumbagg") > 0.5 > s.score("gardens")
    again = toxicity.train(bad + good, [1] * 60 + [0] * 60, toxicity.Settings(prior=1.0))
    assert (again.weight == m.weight).all()


def test_scores_are_sums_over_features(model):
    text = "Some words, some more words."
    words = toxicity.WORDS.findall(text.lower())
    f = [b for w in words for b in toxicity.features(w, model.settings)]
    import math

    z = model.bias + float(model.weight[f].astype(float).sum()) / (len(f) + model.settings.prior)
    assert abs(toxicity.Scored(model).score(text) - 1 / (1 + math.exp(-z))) < 1e-5
