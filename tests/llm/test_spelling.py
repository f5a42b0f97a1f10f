"""Spelling variants against all pairs, with crowded blocks, long words and chains of forms."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lanternlake.llm import queries_spelling, registry, spelling


def apart(a: str, b: str) -> bool:
    """Whether two words are one inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(n: dict[str, int], ratio: int = 10) -> list[tuple]:
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found(spark, n: dict[str, int]) -> list[tuple]:
    known = spark.createDataFrame(list(n.items()), "word string, n bigint").withColumn("s", F.lit(1)).withColumn("block", F.lit("x")).repartition(5)
    return sorted(tuple(r) for r in spelling.variants(known).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_hand_made_words(spark):
    n = {"example": 1000, "exampel": 3, "exmple": 20, "exampl": 100, "examplee": 100, "examplez": 99, "axample": 10, "zzzzzzz": 1, "zzzzzzzz": 2, "zzzzzzzzz": 30, "straße": 5, "strasse": 5, "straßen": 60, "éxample": 4, "exmpel": 2}
    assert found(spark, n) == expected(n)


def test_chains_lead_to_the_last_form(spark):
    n = {"a" * k: 10 ** (k - 3) for k in range(4, 16)}
    rows = found(spark, n)
    assert rows == expected(n) and {r[2] for r in rows} == {"a" * 15}


@pytest.mark.parametrize("letters, low, high, count", [("ab", 1, 9, 700), ("abcé", 7, 8, 900), ("abcdefghij", 7, 9, 400)])
def test_crowded_blocks_equal_all_pairs(spark, monkeypatch, letters, low, high, count):
    monkeypatch.setattr(spelling, "BLOCK", 8)
    rng = random.Random(count)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(count)}
    words |= {w[:3] + rng.choice(letters) + w[3:] for w in list(words)[:100]} | {"prefix" + w for w in list(words)[:150]} | {w + "suffix" for w in list(words)[:150]}
    n = {w: rng.choice([1, 2, 30, 400]) for w in sorted(words)}
    assert found(spark, n) == expected(n)


def test_long_words(spark):
    base = "".join(random.Random(1).choice("abcdefgh") for _ in range(6000))
    n = {base: 90, base[:-1]: 9, base[1:]: 5, base[:3000] + "z" + base[3001:]: 4, base[::-1]: 2, "short": 1}
    assert found(spark, n) == expected(n)


def test_empty_dictionary(spark):
    assert found(spark, {"nothing": 1})[0][1:] == (None, "nothing", 1, 0, None)
    assert spelling.variants(spark.createDataFrame([], "word string, n bigint")).collect() == []


def words_of(rows: list[tuple]) -> dict[str, int]:
    """The dictionary of rows (id, text) by plain rules."""
    out: Counter = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode()) if key is not None else 1
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in out.items() if len(w) >= 7 and k >= 2}


def test_awkward_documents(spark, odd, odd_rows):
    more = [(None, "Überschriften überschriften"), (None, None), (1, "naïveté×÷abc " * 3), (1, "naïveté×÷abc")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    known = spelling.dictionary(queries_spelling.misspelt_runs(docs), 7, 2)
    assert {r.word: r.n for r in known.collect()} == words_of([*odd_rows, *more])


def test_query_equals_all_pairs_and_its_sql(spark, sf_dir, same, documents):
    out = registry.QUERIES["op12_spelling_variants"](spark, sf_dir)
    assert same(out, registry.SQL["op12_spelling_variants"])
    assert {(r.word, r.n) for r in out.collect()} == set(words_of(documents).items())
