"""Substring dedup by suffix automata: reference shards become automata, word sequences are streamed through them for matching statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import IS_SPACE, saved, text_bytes, with_rows, word_bounds, word_ids
from .repeats import Kind, covered, named, repeated, span_lists

#: Symbols of the sequences that one automaton holds; it has at most twice as many states.
SHARD = 40_000


class Automaton:
    """The suffix automaton of several sequences of hashable symbols, with how often each state's strings occur."""

    def __init__(self, sequences: list):
        self.next, self.link, self.length, count = [{}], [-1], [0], [0]
        nexts, link, length = self.next, self.link, self.length
        for sequence in sequences:
            last = 0
            for c in sequence:
                known = nexts[last].get(c)
                if known is not None and length[known] == length[last] + 1:
                    last = known
                elif known is not None:
                    last = self._clone(last, c, known, count)
                else:
                    new = len(nexts)
                    nexts.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    count.append(0)
                    p = last
                    while p >= 0 and c not in nexts[p]:
                        nexts[p][c] = new
                        p = link[p]
                    if p >= 0:
                        q = nexts[p][c]
                        link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q, count)
                    last = new
                count[last] += 1
        for v in np.argsort(length)[:0:-1].tolist():
            count[link[v]] += count[v]
        self.count = count

    def _clone(self, p: int, c, q: int, count: list[int]) -> int:
        nexts, link, length = self.next, self.link, self.length
        clone = len(nexts)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        count.append(0)
        link[q] = clone
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = clone
            p = link[p]
        return clone

    def windows(self, sequence, width: int, least: int) -> list[int]:
        """The starts of the windows of `width` symbols of a sequence that the automaton's sequences hold `least` times or more.

        The matching statistics are walked as far as width: the state is always that of the longest suffix read that occurs, or of
        its last `width` symbols.
        """
        nexts, link, length, count = self.next, self.link, self.length, self.count
        out, v, known = [], 0, 0
        for i, c in enumerate(sequence):
            to = nexts[v].get(c)
            while to is None and v:
                v = link[v]
                known = length[v]
                to = nexts[v].get(c)
            if to is not None:
                v = to
                known += 1
            if known >= width:
                while length[link[v]] >= width:
                    v = link[v]
                    known = length[v]
                if count[v] >= least:
                    out.append(i - width + 1)
        return out


def repeated_windows(stretches: list[list[bytes]], groups: list[int], width: int) -> list[np.ndarray]:
    """The starts of the windows that occur twice among the stretches, which are sorted by group: groups are dealt into shards whole."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(stretches):
        end, size = at, 0
        while end < len(stretches):
            stop = end
            while stop < len(stretches) and groups[stop] == groups[end]:
                stop += 1
            more = sum(len(x) for x in stretches[end:stop])
            if end > at and size + more > SHARD:
                break
            end, size = stop, size + more
        # The words themselves, numbered.
        number: dict[bytes, int] = {}
        shard = [[number.setdefault(w, len(number)) for w in x] for x in stretches[at:end]]
        automaton = Automaton(shard)
        out += [np.array(automaton.windows(x, width, 2), np.int64) for x in shard]
        at = end
    return out


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts, a space between them, and where their words start and end."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    return data, *word_bounds(data)


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, start, end = _words_of(texts)
    ends = np.cumsum([len(x) + 1 for x in texts])
    return word_ids(data, start, end), np.diff(np.searchsorted(start, ends), prepend=0)


def _placed(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' words joined by one space, and where each begins and ends."""
    data, start, end = _words_of(texts)
    at = np.cumsum(end - start + 1)
    return _joined(data, start, end), at - (end - start + 1), at - 1


def word_kind(width: int, gram: int) -> Kind:
    return Kind(width, gram, _symbols, _placed, lambda data: data.split(b" "))


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words that start and end there, joined by one space: each with the byte after it, which is made a space."""
    if not len(start):
        return b""
    step = np.zeros(len(data) + 2, np.int8)
    step[start] += 1
    step[end + 1] -= 1
    spaced = np.full(len(data) + 1, 0x20, np.uint8)
    np.copyto(spaced[:-1], data, where=~IS_SPACE[data])
    return spaced[np.cumsum(step[:-1], dtype=np.int8).view(bool)][:-1].tobytes()


def _removed(docs: DataFrame, texts: bool) -> DataFrame:
    """docs: (row, text binary, spans of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, span in enumerate(span_lists(batch.column(2))):
                data = np.frombuffer(text_bytes(batch.column(1), i), np.uint8)
                start, end = word_bounds(data)
                gone = covered(len(start), *span)
                kept = _joined(data, start[~gone], end[~gone])
                out.append((len(start), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.string()] * 2, strict=True))], ["row", "n_words", "n_removed", "kept_sha256", "kept"])

    return docs.select("row", "text", "spans").mapInArrow(run, "row bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def remove_repeats(docs: DataFrame, width: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) of each row: its words without those that repeated windows cover, joined by one space.

    A window of `width` words is repeated if the same words also start anywhere else, in the same text or another; windows don't
    cross texts and are judged on the texts as given. Null and empty texts have no word. kept is null without texts. The reference
    is the corpus itself, so its shards are not sent to all tasks: each goes, with the stretches that could match it, to
    one. Rows with equal or null ids are rows of their own. Other columns are not read.
    """
    docs, key_col = with_rows(docs.select(id_col, text_col), id_col)
    rows = _rows(docs, key_col, text_col)
    spans = repeated(rows, word_kind(width, gram), lambda data, _, groups: repeated_windows(data, groups, width), "words")
    return named(_removed(rows.join(spans, "row", "left"), texts), docs, key_col, id_col)


#: Words of a reference that are sent to all tasks at once.
REFERENCE_WORDS = 2_000_000


def remove_reference(docs: DataFrame, reference: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text") -> DataFrame:
    """As remove_repeats(), of words that stand in a window of `width` words that the reference texts hold too.

    Parts of the reference of some REFERENCE_WORDS words, or of one longer text, are sent to all tasks one after the other; these make an automaton of each
    shard of a part and stream their documents through it. Words are compared themselves. Null and empty texts hold nothing.
    """
    texts = reference.select(F.col(reference_col).alias("text")).where(F.col(reference_col).isNotNull()).distinct()
    size = F.size(F.split("text", r"[\x20\x09-\x0D]+")).cast("long")
    # Parts by place in an order of the texts: sums of ranges first, so that no task orders all of them.
    ordered = saved(texts.select("text", size.alias("size")).repartitionByRange(F.xxhash64("text"), "text").withColumn("range", F.spark_partition_id()), "reference")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ordered.groupBy("range").agg(F.sum("size").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("range").orderBy("text").rowsBetween(Window.unboundedPreceding, -1)
    parts = saved(ordered.join(ranges, "range").select("text", F.floor((F.col("begin") + F.coalesce(F.sum("size").over(within), F.lit(0))) / REFERENCE_WORDS).alias("part")), "reference-parts")
    docs, key_col = with_rows(docs.select(id_col, text_col), id_col)
    rows, found = _rows(docs, key_col, text_col), None
    for n in range((parts.agg(F.max("part").alias("n")).first()["n"] or 0) + 1):
        marked = _marked(rows, [r.text.encode() for r in parts.where(F.col("part") == n).select("text").collect()], width)
        found = marked if found is None else found.unionByName(marked)
    spans = found.where(F.size("spans") > 0).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return named(_removed(rows.join(spans, "row", "left"), True), docs, key_col, id_col)


def _marked(rows: DataFrame, texts: list[bytes], width: int) -> DataFrame:
    """(row, spans): where windows of the reference texts stand in each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, held, size, number = [], [], 0, {}
        for words in ([*_split(t)] for t in texts):
            held.append([number.setdefault(w, len(number)) for w in words])
            size += len(words)
            if size > SHARD:
                shards.append(Automaton(held))
                held, size = [], 0
        shards += [Automaton(held)] if held else []
        for batch in batches:
            spans = []
            for i in range(batch.num_rows):
                words = [number.get(w, -1) for w in _split(text_bytes(batch.column(1), i))]
                spans.append([{"start": s, "end": s + width} for a in shards for s in a.windows(words, width, 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["row", "spans"])

    return rows.mapInArrow(run, "row bigint, spans array<struct<start:int,end:int>>")


def _split(text: bytes) -> Iterator[bytes]:
    _, start, end = _words_of([text])
    return (text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True))
