"""Substring dedup by suffix arrays: Larsson-Sadakane refinement and Kasai's common prefixes in numpy, shards merged by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_TABLE, with_rows
from .repeats import Kind, covered, named, repeated, span_lists

#: Symbols of a shard, 2**19 at the most: three of these numbers fit a 64-bit sort key.
SHARD = 1 << 18
#: Symbols that the first sort looks at.
FIRST = 5


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of a text of symbols 0 to 256, of fewer than 2**19 symbols.

    Larsson and Sadakane: sort by the first few symbols, then refine only groups that are not single yet, each suffix by
    the rank of the one that begins where its known part ends; the known part doubles. rank is the first place of a suffix's group.
    """
    n = len(text)
    bits = np.uint64(20)
    low = np.uint64((1 << 20) - 1)
    padded = np.zeros(n + FIRST, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(FIRST):
        key = key * np.uint64(257) + padded[i : i + n]
    # 257**5 is under 2**41: with the place, 60 bits; plain sorting of packed keys is faster than sorting places by key.
    packed = np.sort(key << np.uint64(19) | np.arange(n, dtype=np.uint64))
    order = (packed & np.uint64((1 << 19) - 1)).astype(np.int64)
    key = packed >> np.uint64(19)
    first = np.r_[True, key[1:] != key[:-1]]
    slot = np.arange(n)
    group = np.maximum.accumulate(np.where(first, slot, 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    h = FIRST
    while h < n:
        # Single groups begin a group and are followed by another beginning.
        open_slots = np.flatnonzero(~(first & np.r_[first[1:], True]))
        if not len(open_slots):
            break
        who = order[open_slots]
        ahead = who + h
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0).astype(np.uint64)
        packed = np.sort(rank[who].astype(np.uint64) << (bits + bits) | then << bits | who.astype(np.uint64))
        who = (packed & low).astype(np.int64)
        key = packed >> bits
        order[open_slots] = who
        new = np.r_[True, key[1:] != key[:-1]]
        first[open_slots] |= new
        group = np.maximum.accumulate(np.where(new, open_slots, 0))
        rank[who] = group
        h *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, lane_starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """lcp[k]: how many symbols, `most` at the most, suffix order[k] has in common with the one before it; lcp[0] is 0.

    Kasai: walking through the text, a suffix's common prefix is at least that of the suffix one symbol before, less one.
    The lanes (the first `lengths` symbols of stretches of the text) are walked side by side, four symbols at a time where
    four agree; for suffixes that begin outside the lanes lcp is 0.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    padded = np.zeros(n + most + 16, np.uint16)
    padded[:n] = text + 1
    # Four symbols of 16 bits at a time.
    four = padded[: n + most + 8].astype(np.uint64)
    four = four | padded[1 : n + most + 9].astype(np.uint64) << np.uint64(16) | padded[2 : n + most + 10].astype(np.uint64) << np.uint64(32) | padded[3 : n + most + 11].astype(np.uint64) << np.uint64(48)
    out = np.zeros(n, np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = lane_starts[by_length], lengths[by_length]
    h = np.zeros(len(starts), np.int64)
    alive = len(starts)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        while alive and lengths[alive - 1] <= step:
            alive -= 1
        i = starts[:alive] + step
        j = before[i]
        known = np.maximum(h[:alive] - 1, 0)
        known[j < 0] = 0
        go = np.flatnonzero((j >= 0) & (known < most))
        while len(go):
            a, b = four[i[go] + known[go]], four[j[go] + known[go]]
            same = a == b
            differs = a ^ b
            part = np.where(same, 4, (differs & np.uint64(0xFFFF) == 0).astype(np.int64) + (differs & np.uint64(0xFFFFFFFF) == 0) + (differs & np.uint64(0xFFFFFFFFFFFF) == 0))
            known[go] += part
            go = go[same & (known[go] < most)]
        np.minimum(known, most, out=known)
        h[:alive] = known
        out[i] = known
    lcp = out[order]
    lcp[0] = 0
    return lcp


class Shard:
    """The suffix array of several stretches of bytes, and which of their windows of `width` bytes occur twice among them."""

    def __init__(self, stretches: list[np.ndarray], windows: list[int], width: int):
        sizes = np.array([len(x) for x in stretches])
        self.width, self.windows, self.starts = width, windows, np.cumsum(sizes + 1) - sizes - 1
        self.text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
        for s, x in zip(self.starts, stretches, strict=True):
            self.text[s : s + len(x)] = x.astype(np.int64) + 1  # 0 ends a stretch
        self.order, _ = suffix_array(self.text)
        lcp = common_prefixes(self.text, self.order, self.starts, np.array(windows), width)
        shared = lcp >= width
        self.twice = np.zeros(len(self.text), bool)
        self.twice[self.order] = shared | np.r_[shared[1:], False]

    def packed(self, places: np.ndarray, block: int) -> np.ndarray:
        """Three symbols of each suffix, the block-th three, as numbers that sort like them; symbols from `width` on count as none."""
        out = np.zeros(len(places), np.int64)
        for k in range(3 * block, 3 * block + 3):
            out = out << 9
            if k < self.width:
                at = places + k
                out += np.where(at < len(self.text), self.text[np.minimum(at, len(self.text) - 1)], 0)
        return out

    def held(self, other: Shard, places: np.ndarray) -> np.ndarray:
        """Whether each window of another shard that begins at one of the places stands here: by binary search among the suffixes."""
        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.order), np.int64)

        def compare(who: np.ndarray, suffix: np.ndarray) -> np.ndarray:
            """-1, 0 or 1 as the suffix is below, equal to or above the window."""
            out, open_ = np.zeros(len(who), np.int64), np.arange(len(who))
            for block in range(-(-self.width // 3)):
                out[open_] = np.sign(self.packed(suffix[open_], block) - other.packed(places[who[open_]], block))
                open_ = open_[out[open_] == 0]
                if not len(open_):
                    break
            return out

        while len(who := np.flatnonzero(low < high)):
            middle = (low[who] + high[who]) // 2
            below = compare(who, self.order[middle]) < 0
            low[who[below]] = middle[below] + 1
            high[who[~below]] = middle[~below]
        inside = np.flatnonzero(low < len(self.order))
        out = np.zeros(len(places), bool)
        out[inside] = compare(inside, self.order[low[inside]]) == 0
        return out

    def places(self, stretches: list[int]) -> np.ndarray:
        return np.concatenate([self.starts[i] + np.arange(self.windows[i]) for i in stretches])


def repeated_windows(stretches: list[np.ndarray], windows: list[int], groups: list[int], width: int) -> list[np.ndarray]:
    """The starts of the windows of `width` bytes that occur twice among the stretches, which are sorted by group; no window stands in two groups.

    Stretches are dealt in this order into shards of bounded size, each with a suffix array of its own. Shards that hold parts
    of one group are merged by binary search: the group's windows in each are looked up among the suffixes of the others.
    """
    parts: list[list[int]] = [[]]
    size = 0
    for i, x in enumerate(stretches):
        if size + len(x) + 1 >= SHARD and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append(i)
        size += len(x) + 1
    shards = [Shard([stretches[i] for i in part], [windows[i] for i in part], width) for part in parts if part]
    for a in range(len(shards)):
        for b in range(a + 1, len(shards)):
            g = groups[parts[b][0]]
            if groups[parts[a][-1]] != g:
                break
            for one, mine, other in ((a, parts[a], b), (b, parts[b], a)):
                places = shards[one].places([k for k, i in enumerate(mine) if groups[i] == g])
                places = places[~shards[one].twice[places]]
                shards[one].twice[places] = shards[other].held(shards[one], places)
    return [np.flatnonzero(shard.twice[s : s + w]) for shard in shards for s, w in zip(shard.starts, shard.windows, strict=True)]


def _placed(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    data = b"".join(texts)
    at = np.arange(len(data) + 1)
    return data, at[:-1], at[1:]


def byte_kind(width: int, gram: int) -> Kind:
    return Kind(width, gram, lambda texts: (BYTE_TABLE[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(x) for x in texts])), _placed, lambda data: np.frombuffer(data, np.uint8))


def _removed(docs: DataFrame, spans: DataFrame, texts: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, span in enumerate(span_lists(batch.column(2))):
                data = batch.column(1)[i].as_buffer().to_pybytes()
                gone = covered(len(data), *span)
                left = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
                n = int(gone.sum())
                runs = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
                out.append((len(data), n, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if texts else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True))], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.join(spans, "row", "left").select("row", "text", "spans").mapInArrow(run, "row bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, width: int = 400, gram: int = 48, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row: its text in UTF-8 without the bytes that repeated strings cover.

    A string of `width` bytes is repeated if it also starts anywhere else, in the same text or another; strings don't cross texts and
    are judged on the texts as given. Null texts are empty; texts shorter than width stay whole. kept is the remaining text (bytes of
    characters cut in two are left out), null without texts; kept_sha256 is of the remaining bytes. Rows with
    equal or null ids are rows of their own. Other columns are not read.
    """
    docs, key_col = with_rows(docs.select(id_col, text_col), id_col)
    rows = docs.select(F.col(key_col).cast("bigint").alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    spans = repeated(rows, byte_kind(width, gram), lambda data, windows, groups: repeated_windows(data, windows, groups, width), "bytes")
    return named(_removed(rows, spans, texts), docs, key_col, id_col)


def cut(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with their texts as remove_repeats() leaves them; what it leaves alone stays as it is, null too."""
    rows, key_col = with_rows(docs, id_col)
    kept = remove_repeats(rows, width, id_col=key_col, text_col=text_col).where("n_removed > 0").select(F.struct(F.col(key_col).alias("key"), "kept").alias("cut_text"))
    joined = rows.select(F.struct("*").alias("whole")).join(kept, F.col(f"whole.{key_col}") == F.col("cut_text.key"), "left")
    text = F.when(F.col("cut_text").isNotNull(), F.col("cut_text.kept")).otherwise(F.col(f"whole.{text_col}"))
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"whole.{c}").alias(c) for c in docs.columns))
