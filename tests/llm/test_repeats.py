"""Suffix-array and automaton dedup against counting every window."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lanternlake.llm import automaton, queries_repeats, repeats, suffix_array

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def covered(sequences: list, width: int) -> list[list[bool]]:
    seen = Counter(hash(tuple(s[i : i + width]) if isinstance(s, list) else s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        gone, until = [False] * len(s), 0
        for i in range(len(s)):
            if i + width <= len(s) and seen[hash(tuple(s[i : i + width]) if isinstance(s, list) else s[i : i + width])] > 1:
                until = i + width
            gone[i] = i < until
        out.append(gone)
    return out


def plain_bytes(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), data, gone in zip(rows, texts, covered(texts, width), strict=True):
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def plain_words(rows, width):
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    out = []
    for (i, _), w, gone in zip(rows, words, covered(words, width), strict=True):
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("group", [128, 2])
@pytest.mark.parametrize(("width", "gram"), [(400, 48), (60, 8)])
def test_bytes_equal_counting(odd, odd_rows, monkeypatch, width, gram, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    assert rows_of(suffix_array.remove_repeats(odd, width, gram), *BYTES) == plain_bytes(odd_rows, width)


@pytest.mark.parametrize("group", [128, 2])
def test_words_equal_counting(odd, odd_rows, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    assert rows_of(automaton.remove_repeats(odd, 35, 8), *WORDS) == plain_words(odd_rows, 35)


def test_op2_equals_counting(spark, sf_dir, documents):
    assert rows_of(queries_repeats.op2_suffix_array_dedup(spark, sf_dir), *BYTES) == plain_bytes(documents, 400)


def test_op10_equals_counting(spark, sf_dir, documents):
    assert rows_of(queries_repeats.op10_automaton_dedup(spark, sf_dir), *WORDS) == plain_words(documents, 35)


def test_rows_with_equal_and_null_ids_are_rows_of_their_own(spark, odd_rows):
    rows = [(None if i % 3 == 0 else i % 2, t) for i, t in odd_rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(suffix_array.remove_repeats(df, 400), *BYTES) == plain_bytes(rows, 400)
    assert rows_of(automaton.remove_repeats(df, 35), *WORDS) == plain_words(rows, 35)


def test_empty_tables(empty):
    assert suffix_array.remove_repeats(empty, 400).count() == 0
    assert automaton.remove_repeats(empty, 35).count() == 0
    assert suffix_array.cut(empty).columns == empty.columns


def test_cut_keeps_columns_and_what_has_no_repeat(spark, odd, odd_rows):
    out = {r.doc_id: r for r in suffix_array.cut(odd, 400).collect()}
    assert list(out[14].asDict()) == odd.columns
    gone = dict(zip((i for i, _ in odd_rows), covered([(t or "").encode() for _, t in odd_rows], 400), strict=True))
    for i, text in odd_rows:
        expected = text if not any(gone[i]) else bytes(b for b, g in zip(text.encode(), gone[i], strict=True) if not g).decode("utf-8", "ignore")
        assert out[i].text == expected


def test_suffix_array_sorts_suffixes_and_kasai_measures_them():
    rng = random.Random(0)
    for text in (b"", b"a", b"banana", b"aaaaaaaaaaaa", bytes(rng.randrange(3) for _ in range(500)), bytes(rng.randrange(256) for _ in range(500)), b"abcab" * 60):
        if not text:
            continue
        order, _ = suffix_array.suffix_array(np.frombuffer(text, np.uint8).astype(np.int64) + 1)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffix_array.common_prefixes(np.frombuffer(text, np.uint8).astype(np.int64) + 1, order, np.array([0]), np.array([len(text)]), 1000)
        for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
            x, y = text[a:], text[b:]
            k = 0
            while k < min(len(x), len(y)) and x[k] == y[k]:
                k += 1
            assert n == k


@pytest.mark.parametrize("width", [40, 41, 42])
def test_shards_are_merged(monkeypatch, width):
    rng = random.Random(1)
    shared = bytes(rng.randrange(97, 123) for _ in range(90))
    texts = [bytes(rng.choice([0, 255, 97]) for _ in range(rng.randrange(80, 160))) + (shared if k % 3 == 0 else b"") for k in range(12)]
    stretches, windows = [np.frombuffer(t, np.uint8) for t in texts], [len(t) - width + 1 for t in texts]
    groups = [5] * 12
    whole = [x.tolist() for x in suffix_array.repeated_windows(stretches, windows, groups, width)]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    assert whole == [[i for i in range(len(t) - width + 1) if seen[t[i : i + width]] > 1] for t in texts]
    for size in (200, 400, 900):
        monkeypatch.setattr(suffix_array, "SHARD", size)
        assert [x.tolist() for x in suffix_array.repeated_windows(stretches, windows, groups, width)] == whole
    assert any(whole)


@pytest.mark.parametrize("group", [2, 20])
def test_a_passage_in_many_documents(spark, monkeypatch, group):
    """Many texts that share a passage or a part of it, with few or many differing neighbours: groups are cut finer until shards hold them."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(3)
    passage = [f"p{rng.randrange(400)}" for _ in range(160)]
    rows = []
    for i in range(150):
        a, b = (0, 160) if i % 2 else sorted((rng.randrange(80), 80 + rng.randrange(80)))
        edge = rng.choice([3, 500])
        rows.append((i, " ".join([*(f"a{rng.randrange(edge)}" for _ in range(40)), *passage[a:b], *(f"b{rng.randrange(edge)}" for _ in range(40))])))
    rows += [(500, " ".join(passage * 40)), (501, " ".join(passage * 40)), (502, "x" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(suffix_array.remove_repeats(df, 400), *BYTES) == plain_bytes(rows, 400)
    assert rows_of(automaton.remove_repeats(df, 35), *WORDS) == plain_words(rows, 35)


def test_automaton_counts_occurrences():
    rng = random.Random(2)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    a = automaton.Automaton(sequences)
    for width in (1, 2, 4):
        seen = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
        for s in sequences + [[0, 1, 2, 0, 7, 1, 1, 0]]:
            assert a.windows(s, width, 2) == [i for i in range(len(s) - width + 1) if seen[tuple(s[i : i + width])] >= 2]
            assert a.windows(s, width, 1) == [i for i in range(len(s) - width + 1) if seen[tuple(s[i : i + width])] >= 1]


def test_reference_passages_are_removed(spark, odd, odd_rows):
    reference = spark.createDataFrame([(" ".join(odd_rows[10][1].split(" ")[60:100]),), (None,), ("short",)], "text string")
    out = {r.doc_id: r for r in automaton.remove_reference(odd, reference, 13).collect()}
    assert out[20].n_removed == 40 and out[21].n_removed == 40 - 0 or out[21].n_removed > 0
    assert out[33].n_removed == 0 and out[7].n_words == 0


@pytest.mark.parametrize("words", [10, 60, 2_000_000])
def test_a_reference_in_parts_removes_the_same(spark, odd, odd_rows, monkeypatch, words):
    monkeypatch.setattr(automaton, "REFERENCE_WORDS", words)
    reference = [odd_rows[10][1], odd_rows[0][1][:900], None, "", "again again " * 9, odd_rows[15][1] + " x"]
    held = {tuple(w[i : i + 13]) for t in reference for w in [WORD.findall((t or "").encode())] for i in range(len(w) - 12)}
    expected = []
    for i, t in odd_rows:
        w = WORD.findall((t or "").encode())
        gone = {k for i0 in range(len(w) - 12) if tuple(w[i0 : i0 + 13]) in held for k in range(i0, i0 + 13)}
        expected.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    df = spark.createDataFrame([(t,) for t in reference], "text string")
    assert rows_of(automaton.remove_reference(odd, df, 13), *WORDS) == sorted(expected, key=repr)
    assert sum(x[2] for x in expected) > 300


def test_an_empty_reference_removes_nothing(spark, odd):
    none = spark.createDataFrame([], "text string")
    assert automaton.remove_reference(odd, none).agg({"n_removed": "sum"}).first()[0] == 0


def thue_morse(n: int, swapped: bool = False) -> str:
    """Letters by the parity of the bits of their places: sequences whose polynomials modulo 2**64 equal those of the swapped ones."""
    return "".join("ab"[(bin(i).count("1") + swapped) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_equal_polynomials_are_different(spark, n):
    tail = " ".join(f"w{k}" for k in range(34))
    rows = [(1, thue_morse(n) + " " + tail), (2, thue_morse(n, True) + " " + tail), (3, tail + " " + thue_morse(n)), (4, tail + " " + thue_morse(n, True))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(automaton.remove_repeats(df, 35), *WORDS) == plain_words(rows, 35)
    assert all(r[2] == 0 for r in plain_words(rows, 35))


@pytest.mark.parametrize(("width", "group"), [(1024, 128), (1024, 2), (2048, 2)])
def test_bytes_of_equal_polynomials_are_different(spark, monkeypatch, width, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    edge = "0123456789" * 5
    rows = [(k, f"{k} " + edge + thue_morse(width, k % 2 == 1) + edge + f" {k}") for k in range(4)] + [(9, thue_morse(4 * width))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(suffix_array.remove_repeats(df, width), *BYTES) == plain_bytes(rows, width)
