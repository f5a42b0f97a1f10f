"""BPE and edit-aware counts against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from lanternlake.llm import bpe, queries_tokens, token_counts

ODD = ["", " ", "  a", "a  ", "\n\n x", "don't we'll I'VE 'S", "x　y z", "\x1c\x1d a", "٣٤ 12½ Ⅻ", "naïve ümläut 漢字かな \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> a <|endoftext|>", "aaaa" * 300, "_under __score__", "\t\ttab\r\nline \r", "é combining", "\U0001d7d8 math", "\x00"]


@pytest.fixture(scope="session")
def library():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def digest(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plain(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


def test_op9_equals_the_library(spark, sf_dir, documents, library):
    out = queries_tokens.op9_bpe_round_trip(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(library, documents)


def test_odd_texts(spark, odd, odd_rows, library, empty):
    rows = odd_rows + [(900 + i, t) for i, t in enumerate(ODD)] + [(None, "x"), (900, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    path = bpe.vocabulary_path()
    assert sorted((tuple(r) for r in bpe.encode_documents(df, path, ids=False).collect()), key=repr) == plain(library, rows)
    encoded = bpe.encode_documents(df, path)
    assert sorted(((r.doc_id, r.text) for r in bpe.decode_documents(encoded, path).collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert bpe.encode_documents(empty, path).count() == 0


def test_random_characters(library):
    rng, b = random.Random(4), bpe.load(bpe.vocabulary_path())
    letters = "ab AB\n\t'sn't  019_-.,<|>é漢½ ​\U0001f600"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        expected = library.encode(text, add_special_tokens=False).ids
        assert b.encode(text) == expected
        assert ",".join(p for p in bpe.encode_parts(bpe.vocabulary_path(), text)) == ",".join(map(str, expected)) if text else True


def test_pair_tree_gives_the_leftmost_least():
    rng = random.Random(5)
    leaves = [rng.randrange(50) << 32 | i for i in range(700)]
    tree, flat = bpe.PairTree(list(leaves)), list(leaves)
    for _ in range(500):
        i = rng.randrange(700)
        flat[i] = rng.randrange(50) << 32 | i
        tree.put(i, flat[i])
        assert tree.root() == min(flat)


def edited(text, edits):
    for start, end, new in edits:
        start = max(0, min(start, len(text)))
        end = max(start, min(end, len(text)))
        text = text[:start] + new + text[end:]
    return text


def count(library, text):
    b = bpe.load(bpe.vocabulary_path())
    return sum(len(b.encode_pretoken(w)) for w in b.findall(text))


def test_op4_equals_counting_anew(spark, sf_dir, documents, library):
    df = spark.createDataFrame(documents, "doc_id bigint, text string")
    from pyspark.sql import functions as F

    edits = {r.doc_id: [(e.start, e.end, e.new) for e in r.e] for r in df.select("doc_id", token_counts.sample_edits(F.col("text"), F.col("doc_id")).alias("e")).collect()}
    out = {r.doc_id: r for r in queries_tokens.op4_edit_token_counts(spark, sf_dir).collect()}
    assert len(out) == len(documents)
    for i, t in documents:
        assert out[i].n_tokens_before == len(library.encode(t or "", add_special_tokens=False).ids)
        assert out[i].n_tokens == len(library.encode(edited(t or "", edits[i]), add_special_tokens=False).ids)
    long = [r for r in out.values() if r.n_pretokens > 3000]
    assert long and all(r.n_reencoded < r.n_pretokens / 4 for r in long)


@pytest.mark.parametrize("letters", ["ab  \n'sdt 0é漢　.", ["<|endoftext|>", "<|", "endof", "text", "|>", " ", "a", "\n", "<|endoftext"]])
def test_random_edits_keep_the_tree_right(monkeypatch, library, letters):
    rng, b = random.Random(6), bpe.load(bpe.vocabulary_path())
    monkeypatch.setattr(token_counts.CountTree, "FANOUT", 3)
    counts = token_counts.counted(b)
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        tree = token_counts.CountTree(text, b, counts)
        for _ in range(25):
            start = rng.randrange(len(text) + 3)
            edit = (start, start + rng.randrange(-1, 9), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 40]))))
            text = edited(text, [edit])
            tree.edit(*edit)
            assert tree.text() == text
            assert [w for s in tree.slots for w in s] == [w for w, _ in b.pretokens(text)]
            assert tree.n_chars == len(text) and tree.n_tokens == len(library.encode(text, add_special_tokens=False).ids)


def test_a_long_insert_is_not_encoded_again_by_later_edits():
    b = bpe.load(bpe.vocabulary_path())
    tree = token_counts.CountTree("start of it and its end", b, token_counts.counted(b))
    tree.edit(8, 8, " more words" * 20_000)
    before = tree.reencoded
    for k in range(50):
        tree.edit(4_000 * k, 4_000 * k + 3, "x")
    assert tree.reencoded - before < 50 * 200
    assert tree.n_tokens == sum(len(b.encode_pretoken(w)) for w in b.findall(tree.text()))


def test_segments_are_split_where_pretokens_begin(monkeypatch, library):
    rng, path = random.Random(8), bpe.vocabulary_path()
    monkeypatch.setattr(bpe, "SEGMENT", 20)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\t'sn't  019.é漢 <|endoftext|>") for _ in range(rng.randrange(300)))
        ids = library.encode(text, add_special_tokens=False).ids
        joined = ",".join(map(str, ids))
        assert bpe.digests(path, text) == (len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_kept_pretokens_are_bounded():
    kept = bpe.Kept(len, 10_000)
    for i in range(5_000):
        assert kept[f"w{i}"] == len(f"w{i}") and kept["often"] == 5
    assert len(kept) + len(kept.old) < 100 and kept["x" * 10_000] == 10_000 and "x" * 10_000 not in kept


def test_null_edits(spark, empty):
    df = spark.createDataFrame([(1, "some text", [(0, 4, None), None, (None, 2, "x")]), (2, None, None), (None, "", [(5, 1, "abc")]), (1, "same", [])], "doc_id bigint, text string, edits array<struct<start:int,end:int,new:string>>")
    out = sorted(((r.doc_id or 0, r.n_tokens, r.n_edits) for r in token_counts.count_edited(df, bpe.vocabulary_path()).collect()), key=repr)
    assert out == [(0, 1, 1), (1, 1, 0), (1, 1, 2), (2, 0, 0)]
    none = spark.createDataFrame([], df.schema)
    assert token_counts.count_edited(none, bpe.vocabulary_path()).count() == 0
