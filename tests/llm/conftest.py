"""Small tables with the awkward cases, and the documents of the smallest scale."""

from __future__ import annotations

import random

import pytest

WORDS = "ash birch cedar elm fir hazel larch maple oak pine rowan spruce willow yew".split()


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(n))


def awkward() -> list[tuple]:
    """Rows (doc_id, text): copies, near copies, shared passages, self-repeats, nulls, blanks, odd characters, a very long text."""
    shared = prose(1, 120)
    base = prose(2, 200)
    near = base.split(" ")
    near[100] = "changed"
    rows = [
        (10, base), (3, base), (12, " ".join(near)), (5, base.upper()), (7, None), (8, ""), (9, " \n\t "), (14, "one"), (15, "One"), (16, "two words"),
        (20, prose(3, 50) + " " + shared + " " + prose(4, 50)), (21, prose(5, 80) + " " + shared), (22, shared + " " + prose(6, 10)),
        (30, "again " * 150), (31, prose(7, 40) + "\n" + prose(8, 90) + "\n" + prose(8, 90)), (32, "ümläut naïve 漢字 \U0001f600 " * 30), (33, prose(9, 3000)), (34, "\x00\x1c nul " * 20), (35, prose(9, 3000) + " tail"),
    ]
    return rows + [(100 + i, base) for i in range(6)] + [(200 + i, prose(40 + i, 30) + " " + shared) for i in range(6)]


@pytest.fixture(scope="session")
def odd_rows():
    return awkward()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The awkward rows, with columns whose names operators might use themselves."""
    rows = [(i, t, "x", i, None, 1.0) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, row string, id bigint, key string, spans double").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
