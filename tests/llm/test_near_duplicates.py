"""MinHash and p-stable near-dedup against comparing all pairs."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from lanternlake.llm import graph, minhash, queries_dedup, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def roots(n, links):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def plain_near(rows, width, percent):
    rows = sorted(rows)
    sets = [shingles(t, width) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sorted((rows[i][0], len(sets[i]), rows[r][0], r == i) for i, r in enumerate(roots(len(rows), links)))


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def near_rows(seed=0):
    """Groups of copies that drift apart word by word, so that chains of links arise."""
    rng, rows = random.Random(seed), []
    for g in range(8):
        words = [f"w{rng.randrange(500)}" for _ in range(80)]
        for _ in range(10):
            rows.append((len(rows) * 7 % 1001, " ".join(words)))
            words = list(words)
            for _ in range(g % 4):
                words[rng.randrange(80)] = f"x{rng.randrange(500)}"
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, odd, odd_rows, width):
    assert found(minhash.near_duplicates(odd, width, 80)) == plain_near(odd_rows, width, 80)
    rows = near_rows()
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width, 80)) == plain_near(rows, width, 80)


def hashed(elements) -> np.ndarray:
    return np.unique(minhash.mixed(np.array(sorted(elements), np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


@pytest.mark.parametrize("block", [1024, 16])
@pytest.mark.parametrize("percent", [60, 80, 95])
def test_sketches_lose_no_link(spark, monkeypatch, percent, block):
    """Sets that share much of two passages, of very different sizes: the close pairs hold every linked pair of different components that meet in a bucket."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng, rows = random.Random(percent), []
    for i in range(160):
        size, share = rng.choice([6, 60, 60, 400]), rng.choice([0.7, 0.95, 0.99, 1])
        kept = [x for x in range(size * 1000, size * 1000 + size) if rng.random() < share]
        rows.append((i, i % 7, {*kept, *(rng.randrange(10**6, 10**6 + 300) for _ in range(rng.randrange(rng.choice([2, 12]))))}))
    rows = [r for r in rows if r[2]]
    links = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and 100 * len(a[2] & b[2]) >= percent * len(a[2] | b[2])}
    # Two buckets: all rows, and those of even ids.
    members = [(key, i, len(s), c, n, bytearray(minhash.sketch(hashed(s)).tobytes())) for key, n, of in ((1, len(rows), 1), (2, len(rows) // 2, 2)) for i, c, s in rows if i % of == 0]
    df = spark.createDataFrame(members, "key bigint, id bigint, n bigint, component bigint, members bigint, sketch binary")
    found_pairs = [(r.a, r.b) for r in minhash._crossing(df, percent).collect()]
    assert links <= set(found_pairs) and len(links) > 5
    assert len(found_pairs) == len({(a, b) for a, b in found_pairs}) + sum(a % 2 == b % 2 == 0 for a, b in set(found_pairs))
    if percent > 60:
        assert len(set(found_pairs)) < 3 * len(links)


def slotted(n: int, seed: int = 1) -> list[tuple]:
    """Texts of ten shared passages with a slot of four fillings after each: any two have most of their shingles in common, but few enough."""
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(9)] for k in range(10)]
    return [(i, " ".join(w for k, p in enumerate(passages) for w in [*p, f"s{k}f{rng.randrange(4)}"])) for i in range(n)]


def test_pairs_of_slotted_texts_stay_near_their_links(spark, monkeypatch):
    counts = []

    def counted(rows, percent, made=minhash._crossing):
        pairs = made(rows, percent).distinct()
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_crossing", counted)
    for n in (100, 200, 400):
        rows = slotted(n)
        assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 80)) == plain_near(rows, 4, 80)
        sets = [shingles(t, 4) for _, t in rows]
        links = sum(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in range(n) for b in range(a))
        # All pairs are 4,950, 19,900 and 79,800.
        assert counts[-1] <= 10 * (links + 10), (counts, links)


def test_shingles_of_words_with_equal_polynomials_are_different(spark):
    swap = lambda n, by: "".join("ab"[(bin(i).count("1") + by) % 2] for i in range(n))
    rows = [(10 * k + by, f"{swap(n, by)} one two three") for k, n in enumerate((1024, 2048, 4096)) for by in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(minhash.near_duplicates(df, 4, 80)) == plain_near(rows, 4, 80) == sorted((i, 1, i, True) for i, _ in rows)


def test_op5_equals_all_pairs(spark, sf_dir, documents):
    assert found(queries_dedup.op5_minhash_near_dedup(spark, sf_dir)) == plain_near(documents, 4, 80)


def test_equal_and_null_ids(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "z y x"), (2, None)], "doc_id bigint, text string")
    out = minhash.near_duplicates(df).collect()
    assert len(out) == 5 and sum(r.kept for r in out) == 3
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id) == [(False, 1), (False, 2)]


def test_keep_one_keeps_columns(odd, odd_rows):
    out = minhash.keep_one(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in plain_near(odd_rows, 5, 80) if r[3])


def test_empty_tables(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_bands_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(3)
    expected = (700 / 900) ** minhash.ROWS
    agree = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 900, dtype=np.uint64)
        agree.append(np.mean(minhash.band_keys(x[:800]) == minhash.band_keys(x[100:])))
    assert abs(np.mean(agree) - expected) < 0.05


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    df = spark.createDataFrame([*path, *star, (2000, 2000), (None, 3), (5000, 4999), (4999, 5000)], "a bigint, b bigint")
    out = {r.id: r.component for r in graph.components(df).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 4999: 4999, 5000: 4999}


# ------------------------------------------------------------------ vectors


def plain_vectors(rows, least):
    rows = sorted(rows, key=lambda r: r[0])
    good = [v is not None and len(v) > 0 and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for g, (_, v, _) in zip(good, rows, strict=True)]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if good[a] and good[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((rows[i][0], n[i], rows[r][0], r == i) for i, r in enumerate(roots(len(rows), links)))


def found_vectors(df):
    return sorted(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def test_op7_equals_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found_vectors(queries_dedup.op7_embedding_near_dedup(spark, sf_dir)) == plain_vectors(rows, 0.93)


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.02 * g).tolist(), g % 3))
    rows += [(500 + i, rows[0][1], 0) for i in range(10)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None, 1.0], 1), (604, [], 1), (605, rows[3][1], None), (606, [float("inf")] + [1.0] * 15, 0), (607, [1.0, 2.0], 0), (608, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "vec_id bigint, embedding array<double>, label int, id int, cells string")
    assert found_vectors(vectors.near_vectors(df, 0.93)) == plain_vectors(rows, 0.93)
