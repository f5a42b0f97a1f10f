"""Token counts that follow edits: a segment tree of pre-tokens for each document.

Leaves hold pre-tokens with their characters and tokens; inner nodes hold the sums. An edit re-encodes
only the pre-tokens that it touches, with as much context on both sides as their boundaries depend on,
and updates the sums on the way to the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe as B


def counted(bpe: B.Bpe) -> B.Kept:
    """Pre-token to its number of tokens: one for a special token."""
    return B.Kept(lambda word: 1 if word in bpe.special else len(bpe.encode_pretoken(word)))


class CountTree:
    """The pre-tokens of one text under a segment tree of (characters, tokens).

    A slot holds any number of neighbouring pre-tokens: an edit puts what it re-encodes into the first
    slot that it touches and empties the others, so that the tree keeps its shape; where an insert is too long for them, the tree
    is built anew over the same pre-tokens.
    """

    #: Pre-tokens in a slot of a new tree.
    FANOUT = 32

    def __init__(self, text: str, bpe: B.Bpe, counts: B.Kept):
        self.counts, self.bpe = counts, bpe
        #: Characters beside an edit that it may change: a special token may come about or go there.
        self.reach = max(map(len, bpe.special), default=1)
        self.reencoded = 0
        self._build(self._split(text))

    def _build(self, words: list[str]) -> None:
        k, counts = self.FANOUT, self.counts
        self.slots = [words[i : i + k] for i in range(0, len(words), k)] or [[]]
        self.size = size = 1 << (len(self.slots) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for i, slot in enumerate(self.slots):
            self.chars[size + i], self.tokens[size + i] = sum(map(len, slot)), sum(map(counts.__getitem__, slot))
        for i in range(size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _split(self, text: str) -> list[str]:
        return [word for word, _ in self.bpe.pretokens(text)] if any(x in text for x in self.bpe.special) else self.bpe.findall(text)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _slot_at(self, place: int) -> tuple[int, int]:
        """The slot that holds the character at a place, and where that slot begins; the last slot for the text's end."""
        i, start = 1, 0
        while i < self.size:
            left = self.chars[2 * i]
            if place - start < left:
                i *= 2
            elif self.chars[2 * i + 1]:
                start += left
                i = 2 * i + 1
            else:
                i *= 2
        return i - self.size, start

    def _put(self, slot: int, words: list[str]) -> None:
        self.slots[slot] = words
        i = slot + self.size
        self.chars[i], self.tokens[i] = sum(map(len, words)), sum(map(self.counts.__getitem__, words))
        i >>= 1
        while i:
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
            i >>= 1

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end, clipped to the text, by new."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        if start == end and not new:
            return
        first, at = self._slot_at(start)
        last, last_at = self._slot_at(end)
        text_of = lambda i: "".join(self.slots[i])
        head = text_of(first)[: start - at]
        old = text_of(last)
        tail = old[end - last_at :]
        # To the left: the matching of a pre-token looks at what follows it, never at what precedes, so besides the last slot
        # before that is not empty (its last pre-token may end elsewhere, or its runs of spaces) only what a special token can reach may change.
        context, seen = [], 0
        while first > 0 and seen < self.reach:
            first -= 1
            context = self.slots[first] + context
            seen += self.chars[first + self.size]
        # To the right: go on until a pre-token begins where one began before, and what a special token can reach is as it was.
        words, open_text, done = [], "".join(context) + head + new + tail, last
        while True:
            ahead, seen, upto = [], 0, done + 1
            while upto < len(self.slots) and seen < self.reach:
                ahead += self.slots[upto]
                seen += self.chars[upto + self.size]
                upto += 1
            split = self._split(open_text)
            if not ahead:
                done = upto - 1
                break
            if self._split(open_text + "".join(ahead)) == split + ahead:
                break
            # What is well before the end stays: only the end is split again with what follows.
            keep, left = len(split), self.reach
            while keep and left > 0:
                keep -= 1
                left -= len(split[keep])
            keep = max(keep - 1, 0)
            words += split[:keep]
            done += 1
            open_text = "".join(split[keep:]) + "".join(self.slots[done])
        words += split
        self.reencoded += len(words)
        k = done - first + 1
        share = -(-len(words) // k)
        if share > 4 * self.FANOUT:
            self._build([w for slot in self.slots[:first] for w in slot] + words + [w for slot in self.slots[done + 1 :] for w in slot])
            return
        for i in range(k):
            part = words[i * share : (i + 1) * share]
            if part or self.slots[first + i]:
                self._put(first + i, part)

    def text(self) -> str:
        return "".join("".join(x) for x in self.slots)


def count_edited(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(id, n_tokens_before, n_tokens, n_edits, n_pretokens, n_reencoded) of each row.

    edits_col: array<struct<start int, end int, new string>>, applied one after the other, each to the text as the
    one before it left it, in characters; offsets are clipped to the text, null edits and null parts count as nothing
    to do (start and end) or as the empty text (new). A null text is empty. Special tokens count as one.
    Rows are independent of one another; other columns are not read. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = B.load(path)
        counts = counted(bpe)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = CountTree(text or "", bpe, counts)
                before, pretokens, edits = tree.n_tokens, sum(map(len, tree.slots)), [x for x in edits or [] if x is not None]
                for x in edits:
                    if x["start"] is not None and x["end"] is not None:
                        tree.edit(x["start"], x["end"], x["new"] or "")
                out.append((before, tree.n_tokens, len(edits), pretokens, tree.reencoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5))], ["id", "n_tokens_before", "n_tokens", "n_edits", "n_pretokens", "n_reencoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    columns = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"))
    return columns.mapInArrow(run, f"id {kind}, n_tokens_before bigint, n_tokens bigint, n_edits bigint, n_pretokens bigint, n_reencoded bigint").withColumnRenamed("id", id_col)




def sample_edits(text, doc_id) -> F.Column:
    """Three edits that follow from a document's id and length: one replaces some characters, one inserts a line, one deletes.

    A null text counts as empty and a null id as the empty string, so rows with equal ids and lengths have the same edits.
    """
    n = F.length(F.coalesce(text, F.lit("")))
    key = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    edit = lambda start, end, new: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("new"))
    at = lambda k: F.pmod(key * F.lit(k), n + 1)
    return F.array(edit(at(3), at(3) + 7, "revised 2024"), edit(at(5), at(5), "\n  it's inserted here "), edit(at(11), at(11) + 40, ""))
