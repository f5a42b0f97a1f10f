"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The vocabulary file is a tokenizer description in JSON with byte-level BPE; its path is a parameter
and only its name travels to the tasks, each of which reads it from the installed package.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes, about, of pre-tokens seen before that a task keeps in each of two generations, and the longest of them that it keeps.
CACHE_BYTES, CACHED = 24 << 20, 48
#: Characters of a text that are split at once, about.
SEGMENT = 1 << 16
_NONE = 1 << 62


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def char_class(prefix: str) -> str:
    """The characters of a Unicode general category as ranges of a regular expression's class."""
    out, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == prefix
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}" if code - 1 > start else f"\\U{start:08x}")
            start = None
    return "".join(out)


@functools.cache
def pretoken_findall() -> Callable[[str], list[str]]:
    """Splits a text as the byte-level pre-tokenizer does, with the plain regular expressions.

    Their own classes of letters, digits and white space are faster and the same for all but a few characters;
    texts with one of those take a pattern in which the Unicode classes are written out.
    """
    letter, number = char_class("L"), char_class("N")
    # fixed values: the characters of the property White_Space
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    exact = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    plain = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    plane = [c for code in range(0x10000) if unicodedata.category(c := chr(code)) != "Cs"]
    differs = [c for c in plane if c.isalnum() != (unicodedata.category(c)[0] in "LN") or c.isspace() != (re.match(f"[{space}]", c) is not None) or unicodedata.category(c) in ("Nl", "No")]
    odd, beyond, control = re.compile("[" + "".join(map(re.escape, differs)) + "]").search, re.compile("[\U00010000-\U0010ffff]").search, re.compile("[\x1c-\x1f]").search
    return lambda text: exact(text) if (control(text) if text.isascii() else odd(text) or beyond(text)) else plain(text)


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTree:
    """A segment tree over the places of a word; each leaf holds the rank of the pair that begins there, combined with the place.

    A node covers FAN nodes of the level below and holds their least value, so the root holds the lowest
    rank and, of equal ones, the leftmost; a point update recomputes one node on each level. Up to FAN pairs the
    tree is a root over leaves; encode_pretoken() keeps those leaves in a list that closes up as pairs are merged.
    """

    FAN = 16

    def __init__(self, leaves: list[int]):
        self.levels = [leaves]
        while len(leaves) > 1:
            leaves = [min(leaves[i : i + self.FAN]) for i in range(0, len(leaves), self.FAN)]
            self.levels.append(leaves)

    def root(self) -> int:
        return self.levels[-1][0]

    def put(self, place: int, value: int) -> None:
        fan, below = self.FAN, None
        for level in self.levels:
            if below is not None:
                place //= fan
                value = min(below[place * fan : (place + 1) * fan])
            if level[place] == value:
                return
            level[place] = value
            below = level


class Bpe:
    """One vocabulary: encodes pre-tokens, splits texts, decodes ids."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.token_bytes = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.byte_ids = [0] * 256
        for token, i in vocab.items():
            if len(token) == 1:
                self.byte_ids[alphabet[token]] = i
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges, self.merged = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.merges[vocab[a], vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.findall = pretoken_findall()

    def encode_pretoken(self, word: str) -> list[int]:
        """Merges the leftmost pair of lowest rank until no pair can be merged."""
        ids = [self.byte_ids[b] for b in word.encode("utf-8")]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, merged = self.merges.get, self.merged
        if n <= PairTree.FAN + 1:
            leaves = [rank_of(pair, _NONE) for pair in zip(ids, ids[1:])]
            while leaves and (low := min(leaves)) < _NONE:
                i = leaves.index(low)
                ids[i] = merged[low]
                del ids[i + 1], leaves[i]
                if i < len(leaves):
                    leaves[i] = rank_of((ids[i], ids[i + 1]), _NONE)
                if i:
                    leaves[i - 1] = rank_of((ids[i - 1], ids[i]), _NONE)
            return ids
        leaves = [_NONE if (found := rank_of(pair)) is None else found << 32 | i for i, pair in enumerate(zip(ids, ids[1:]))]
        tree = PairTree(leaves)
        root, put = tree.root, tree.put
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := root()) < _NONE:
            i = low & 0xFFFFFFFF
            j = after[i]
            ids[i], ids[j] = merged[low >> 32], -1
            k = after[i] = after[j]
            if j < n - 1:
                put(j, _NONE)
            found = None
            if k < n:
                before[k] = i
                found = rank_of((ids[i], ids[k]))
            put(i, _NONE if found is None else found << 32 | i)
            if (h := before[i]) >= 0:
                found = rank_of((ids[h], ids[i]))
                put(h, _NONE if found is None else found << 32 | h)
        return [x for x in ids if x >= 0]

    def pretokens(self, text: str) -> Iterator[tuple[str, bool]]:
        """The pre-tokens in order, each with whether it is a special token."""
        for k, piece in enumerate(self.special_split.split(text) if self.special_split else [text]):
            if k % 2:
                yield piece, True
            else:
                for word in self.findall(piece):
                    yield word, False

    def encode(self, text: str) -> list[int]:
        return [i for word, special in self.pretokens(text) for i in ([self.special[word]] if special else self.encode_pretoken(word))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def load(path: str) -> Bpe:
    return Bpe(path)


class Kept(dict):
    """Pre-token to what `make` makes of it. Once full, the entries become the old generation, from which those still used move on."""

    def __init__(self, make: Callable, limit: int = CACHE_BYTES):
        self.make, self.limit, self.held, self.old = make, limit, 0, {}

    def __missing__(self, word: str):
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= CACHED:
            self.held += 240 + 6 * len(word)
            if self.held > self.limit:
                self.old, self.held = dict(self), 0
                self.clear()
            self[word] = out
        return out


_BREAK = re.compile(r"(?<=\S)[ \n]")


def segments(text: str) -> Iterator[str]:
    """A text in parts of about SEGMENT characters, or longer where no white space follows on a visible character: a pre-token always begins there."""
    at = 0
    while len(text) - at > SEGMENT and (found := _BREAK.search(text, at + SEGMENT)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


@functools.cache
def caches(path: str) -> tuple[Bpe, Kept, dict[str, bytes]]:
    """A vocabulary, the ids of pre-tokens joined by commas, and the bytes of each id."""
    bpe = load(path)
    return bpe, Kept(lambda word: ",".join(map(str, bpe.encode_pretoken(word)))), {str(i): b for i, b in bpe.token_bytes.items()}


def encode_parts(path: str, text: str) -> Iterator[str]:
    """The ids of a text in strings joined by commas, one for each of its segments or special tokens."""
    bpe, encoded, _ = caches(path)
    special = bpe.special and any(x in text for x in bpe.special)
    for k, piece in enumerate(bpe.special_split.split(text) if special else [text]):
        if k % 2:
            yield str(bpe.special[piece])
        elif piece:
            for part in segments(piece):
                yield ",".join(map(encoded.__getitem__, bpe.findall(part)))


def decode_part(path: str, ids: str) -> bytes:
    return b"".join(map(caches(path)[2].__getitem__, ids.split(",")))


def digests(path: str, text: str) -> tuple[int, str, str]:
    """The number of a text's tokens, and the SHA-256 of its ids joined by commas and of the text decoded from them."""
    n, ids, decoded, utf8 = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
    for part in encode_parts(path, text):
        ids.update((("," if n else "") + part).encode())
        n += part.count(",") + 1
        decoded.update(utf8.decode(decode_part(path, part)).encode())
    decoded.update(utf8.decode(b"", True).encode())
    return n, ids.hexdigest(), decoded.hexdigest()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(id, ids array<int>) or, with ids=False, (id, n_tokens, ids_sha256, decoded_sha256) for each row.

    Null and empty texts have no tokens. Rows are independent of one another: repeated ids give repeated
    rows, and other columns are not read. One pass without a shuffle; a batch of rows is in memory at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(1))
            if ids:
                rows = [[int(i) for p in encode_parts(path, t) for i in p.split(",")] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["id", "ids"])
                continue
            count, ids_sha, text_sha = zip(*(digests(path, t) for t in texts), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ("ids array<int>" if ids else "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids): the text of each list of ids; null lists give the empty text, bytes that aren't UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
