"""Mixing and quality rules: SQL, plain counts, awkward rows, and plans without Python."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from lanternlake.llm import mixing, quality, queries_native, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf_dir, same, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.SQL[name])


@pytest.mark.parametrize("query", [queries_native.op6_mix_sources, queries_native.op8_quality_rules])
def test_no_python_in_the_plan(spark, sf_dir, query):
    plan = query(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def rows(spark):
    data = [(i, None if i % 7 == 0 else f"s{i % 4}", None if i % 11 == 0 else " ".join(["w"] * (i % 13)), i) for i in range(300)]
    data += [(i, "hot", "a b c " * 5, i) for i in range(1000, 1400)] + [(5, "s1", "twice over", 0), (None, "s2", "no id", 0), (None, "s2", "no id", 0), (7000, "bare", "  ", 1)]
    return spark.createDataFrame(data, "doc_id bigint, source string, text string, key bigint")


def test_takes_come_to_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    monkeypatch.setattr(mixing, "BLOCK_RANGES", 4)
    sized = rows(spark).withColumn("size", mixing.text_size())
    out = mixing.mix(sized).collect()
    assert len(out) == sized.count()
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        assert r.taken <= 2 * r.size
        t = by.setdefault(r.source, [r.target, 0, r.source_size, 0])
        t[1] += r.taken
        t[3] += r.size
    for target, taken, size, real in by.values():
        assert size == real and abs(target - taken) <= 1 and target <= 2 * size + 1e-9
    assert abs(sum(t[0] for t in by.values()) - min(1.5 * total, 2 * total)) < 1e-6
    order = sorted(by, key=lambda s: (s is None, s or ""))
    level = [by[s][0] / mixing.WEIGHTS[i % 3] for i, s in enumerate(order) if by[s][0] < 2 * by[s][2] - 1e-9]
    assert max(level) - min(level) < 1e-6
    again = mixing.mix(sized.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in out)


def test_the_mix_is_applied(spark):
    docs = rows(spark)
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    taken = {r.source: 0 for r in docs.select("source").distinct().collect()}
    for r in out.collect():
        taken[r.source] += len(WORD.findall(r.text))
    for r in mixing.mix(docs.withColumn("size", mixing.text_size())).select("source", "target").distinct().collect():
        assert abs(taken[r.source] - r.target) <= 1


def test_empty_and_wordless_tables(spark, empty):
    assert mixing.apply_mix(empty).count() == 0
    assert mixing.mix(empty.withColumn("size", mixing.text_size())).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "a", " ")], "doc_id bigint, source string, text string")
    assert [r.taken for r in mixing.mix(none.withColumn("size", mixing.text_size())).collect()] == [0, 0]
    assert mixing.apply_mix(none).count() == 0


# ------------------------------------------------------------------ quality


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def found(df):
    return sorted(((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()), key=repr)


def test_op8_counts_equal_plain_ones(spark, sf_dir, documents):
    out = queries_native.op8_quality_rules(spark, sf_dir)
    assert found(out) == sorted(((i or 0, *plain_counts(t)) for i, t in documents), key=repr)
    assert all(not (r.base_failed and r.kept) for r in out.collect())


def test_awkward_counts(spark, odd, odd_rows, empty):
    assert found(quality.rate(odd)) == sorted(((i, *plain_counts(t)) for i, t in odd_rows), key=repr)
    df = spark.createDataFrame([(None, None), (None, ""), (1, "a\nb\na\n a\n" * 20), (1, "x y z v w " * 3)], "doc_id bigint, text string")
    assert found(quality.rate(df)) == sorted([(0, *plain_counts(None)), (0, *plain_counts("")), (1, *plain_counts("a\nb\na\n a\n" * 20)), (1, *plain_counts("x y z v w " * 3))], key=repr)
    assert quality.rate(empty).count() == 0


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(r.kept, labels[r.doc_id]) for r in queries_native.op8_quality_rules(spark, sf).collect() if labels.get(r.doc_id) is not None]
    good = [k for k, y in out if y == 1]
    poor = [k for k, y in out if y == 0]
    assert sum(good) / len(good) > 0.9
    assert sum(poor) / len(poor) < sum(good) / len(good)


def test_estimates_find_accuracies():
    patterns = [((-1, 0), 100), ((1, 1), 800), ((1, 0), 90), ((-1, -1), 50)]
    log_odds, weights = quality.estimate(patterns)
    assert log_odds > 0 and weights[0][-1] < 0 <= weights[0][1] and weights[1][-1] < 0
    assert quality.estimate([])[1] == []
