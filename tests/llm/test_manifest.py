"""Merkle manifests against a plain tree, with awkward rows, and proofs that a reader can check."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lanternlake.llm import merkle, registry
from lanternlake.llm.queries_manifest import COLUMNS

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row: dict) -> str:
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(digests: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each digest the siblings to its left and right at each level."""
    steps = [[] for _ in digests]
    owners = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        above, owned = [], []
        for a in range(0, len(digests), arity):
            run = digests[a : a + arity]
            for k, who in enumerate(owners[a : a + arity]):
                for w in who:
                    steps[w].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(h("".join(run)))
            owned.append([w for who in owners[a : a + arity] for w in who])
        digests, owners = above, owned
    return digests[0], steps


def plain(rows: list[dict], arity: int) -> list[tuple]:
    """(id, leaf, subroot, root, proof) of each row."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r["doc_id"]))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = []
    for name in names:
        members = sorted(groups[name])
        made.append((members, *tree([m[2] for m in members], arity)))
    root, over = tree([m[1] for m in made], arity)
    return [(m[3], m[2], subroot, root, h("".join(a + b for a, b in [*steps[k], *over[g]]))) for g, (members, subroot, steps) in enumerate(made) for k, m in enumerate(members)]


def fixture(n: int, seed: int = 3) -> list[dict]:
    rng = random.Random(seed)
    rows = [{"doc_id": rng.randrange(-50, 10**6), "text": rng.choice(["", "Aa", "é:ü", "x" * 3000, None, f"t{k}"]), "lang": rng.choice(["en"] * 20 + ["de", "é", "z", "", None]), "source": rng.choice([None, "s"]), "n_chars": rng.choice([None, k])} for k in range(n)]
    return rows + rows[:3] + [{"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}] * 2 + [{"doc_id": 1, "text": "alone", "lang": "one", "source": "s", "n_chars": 1}]


@pytest.mark.parametrize("n, arity", [(1500, 8), (700, 2), (40, 3), (0, 8)])
def test_manifest_equals_a_plain_tree(spark, n, arity):
    rows = fixture(n)
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    clash = df.withColumn("g", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("name", F.lit("y")).repartition(7)
    out = merkle.manifest(clash, COLUMNS, arity=arity, steps=True)
    # A reader needs the leaf and the steps alone.
    checked = out.select("*", merkle.folded(F.col("leaf"), F.col("steps")).alias("again")).collect()
    key = lambda x: tuple((y is not None, y or 0) if not isinstance(y, str) else y for y in x)
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in checked], key=key) == sorted(plain(rows, arity), key=key)
    assert all(r.again == r.root == r.folded_root and r.verified for r in checked)


def test_tampered_rows_fold_to_another_root(spark):
    rows = fixture(300)
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    out = merkle.manifest(df, COLUMNS, changed={"text": F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))}, steps=True)
    texts = {}
    for r in rows:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for r in out.collect():
        if len(set(texts[r.doc_id])) == 1:
            same = r.doc_id is None or r.doc_id % 2 or texts[r.doc_id][0] in (None, "") or texts[r.doc_id][0].lower() == texts[r.doc_id][0]
            assert r.verified == bool(same) and r.verified == (r.folded_root == r.root)


def test_forests_merge_in_any_order():
    rng = random.Random(5)
    leaves = [(k, h(str(k))) for k in range(203)]
    root, _ = tree([x for _, x in leaves], 4)
    for _ in range(20):
        rng.shuffle(leaves)
        parts = []
        for a in range(0, len(leaves), 17):
            f = merkle.Forest(4)
            for i, d in leaves[a : a + 17]:
                f.put(7, 203, 0, i, d)
            parts.append(f)
        while len(parts) > 1:
            rng.shuffle(parts)
            parts.append(parts.pop().merge(parts.pop()))
        assert not parts[0].open
        assert [x for x in parts[0].made if x[2] == merkle.depth_of(203, 4)] == [(7, 203, 4, 0, root, False)]


def test_empty_table(spark, empty):
    out = merkle.manifest(empty, COLUMNS)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.collect() == []


def test_query_equals_its_sql(spark, sf_dir, same):
    assert same(registry.QUERIES["op11_merkle_manifest"](spark, sf_dir), registry.SQL["op11_merkle_manifest"])
