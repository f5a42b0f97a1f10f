"""What suffix-array and automaton dedup share: which stretches of the corpus can hold a repeated window, and who gets them.

A text is a sequence of symbols (bytes or words). A window is `window` symbols of one document; it repeats if the same
symbols also start anywhere else. Each window has an anchor: of its `gram`-grams the leftmost with the least hash. Equal
windows have equal anchors at the same place, so only stretches whose anchor occurs twice need looking at:

1. anchors(): each document's anchors, each with the stretch of all windows that it stands for.
2. Stretches that are equal as a whole (by 128-bit digests of their content) are one, with a number of occurrences; if it is more than one, all
   its windows repeat.
3. Anchors with several different stretches: those go to shards by anchor, where a method (suffix arrays, automata)
   finds the repeated windows among them.
4. Anchors with more different stretches than a shard should hold (a passage in very many documents) are cut finer first, by the same
   rules: the windows that begin in the same few places before the anchor have a core in common, so each piece of a stretch is
   dealt by its core instead of its anchor, equal pieces are one, and groups of different pieces go to shards, or are
   cut finer again if there are still too many. A piece of one window is all core, so this ends. No task gets a group of unbounded size.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, digests, dropped, mixed, prefix_hash, saved, sliding_hash, text_bytes

#: Different stretches of an anchor, or pieces with a core, that go to a shard as they are, and pieces into which those of larger groups are cut.
GROUP, PIECES = 128, 16
#: Bytes of symbols that a bucket of shards gets on average.
BUCKET_BYTES = 1 << 19
#: Bytes of texts, about, whose anchors are computed together.
TEXT_BYTES = 1 << 15


@dataclass(frozen=True)
class Kind:
    """symbols: hashed symbols of several texts' bytes, one after the other, and their numbers, for anchors. placed: these texts' content in
    one form, and where each symbol begins and ends in it, so that stretches of equal symbols are equal bytes. unpack: a stretch's content as symbols, for the method.
    """

    window: int
    gram: int
    symbols: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    placed: Callable[[list[bytes]], tuple[bytes, np.ndarray, np.ndarray]]
    unpack: Callable[[bytes], object]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, by minima from the left and right within blocks."""
    n = len(x)
    if width == 1:
        return x
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(symbols: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first, last, place) of several texts' symbols, one text after the other, `sizes` of each.

    The number of the text, the anchor's hash, the first and last window start, and where the anchor is, in its text.
    """
    begins, starts = np.cumsum(sizes) - sizes, np.maximum(sizes - window + 1, 0)
    before = np.cumsum(starts)
    if not before[-1]:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32))
    prefix = prefix_hash(symbols)
    h = sliding_hash(prefix, gram)
    least = sliding_least((h >> np.uint64(32)) << np.uint64(32) | np.arange(len(h), dtype=np.uint64), window - gram + 1)
    # Only windows that lie in one text, numbered through.
    place = np.concatenate([least[i : i + m] for i, m in zip(begins.tolist(), starts.tolist(), strict=True)])
    new = np.r_[True, place[1:] != place[:-1]]
    new[(before - starts)[starts > 0]] = True
    new = np.flatnonzero(new)
    at = (place[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(before, new, "right")
    shift = (begins - before + starts)[text]
    first, last = new + shift, np.r_[new[1:], len(place)] - 1 + shift
    begin = begins[text]
    return text, h[at].view(np.int64), (first - begin).astype(np.int32), (last - begin).astype(np.int32), (at - begin).astype(np.int32)


def _anchor_table(docs: DataFrame, kind: Kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, at = batch.column(0).to_numpy(), [], 0
            while at < batch.num_rows:
                texts, size, begin = [], 0, at
                while at < batch.num_rows and size < TEXT_BYTES:
                    texts.append(text_bytes(batch.column(1), at))
                    size += len(texts[-1])
                    at += 1
                symbols, sizes = kind.symbols(texts)
                text, anchor, first, last, place = anchors(symbols, sizes, kind.window, kind.gram)
                data, start, end = kind.placed(texts)
                begins = (np.cumsum(sizes) - sizes)[text]
                stretch = digests(data, start[begins + first], end[begins + last + kind.window - 1])
                parts.append([ids[begin + text], anchor, stretch, first, last, place])
                if len(parts) == 64 or at == batch.num_rows:
                    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    yield pa.RecordBatch.from_arrays([binary_column(c) if c.ndim == 2 else pa.array(c) for c in columns], ["row", "anchor", "stretch", "first", "last", "place"])
                    parts = []

    return docs.select("row", "text").mapInArrow(run, "row bigint, anchor bigint, stretch binary, first int, last int, place int")


SHARED = "anchor bigint, stretch binary, key bigint, n bigint, many boolean, offset int, windows int, shift int, data binary"
SHARED_NAMES = [x.split(" ")[0] for x in SHARED.split(", ")]
SHARED_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows, whose last field may be long, in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _stretches(docs: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """SHARED rows for the wanted stretches (row, anchor, stretch, n, many, first, last, place), cut out of their documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_buffer().to_pybytes()
                content, start, end = kind.placed([text])
                for x in batch.column(2)[i].as_py():
                    data = content[start[x["first"]] : end[x["last"] + kind.window - 1]]
                    yield x["anchor"], x["stretch"], x["anchor"], x["n"], x["many"], x["place"] - x["first"], x["last"] - x["first"] + 1, 0, data

    per_row = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "stretch", "n", "many", "first", "last", "place")).alias("wanted"))
    return docs.select("row", "text").join(per_row, "row").select("row", "text", "wanted").mapInArrow(lambda b: _batches(rows(b), SHARED_NAMES, SHARED_TYPES), SHARED)


#: Window starts of a stretch, counted from its first, that repeat: first to last.
FOUND = "anchor bigint, stretch binary, first int, last int"


def _cut_finer(members: DataFrame, kind: Kind, step: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(FOUND rows, SHARED rows): the windows of pieces that occur twice as a whole, and the different pieces of each other group that has several.

    members: SHARED rows. Piece j of one holds its windows that begin j * step to (j + 1) * step - 1 symbols before the anchor; its core
    is what all these have in common, whether the member holds all of them or not.
    """
    window = kind.window

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                (data, start, end), offset = kind.placed([x["data"]]), x["offset"]
                j = np.arange((offset - x["windows"] + 1) // step, offset // step + 1)
                low, high = offset - (j + 1) * step + 1, offset - j * step
                first, last = np.maximum(low, 0), np.minimum(high, x["windows"] - 1)
                # A core tells groups apart, within its key and piece; a hull says what is equal.
                core = digests(data, start[high], end[low + window - 1])[:, 0] ^ mixed(np.array([x["key"]]).view(np.uint64) + j.astype(np.uint64)).view(np.int64)
                hull = np.c_[digests(data, start[first], end[last + window - 1]), high - first]
                m = len(j)
                fixed = [np.full(m, x[c]) for c in ("anchor", "key", "n")]
                out.append([core, hull, np.tile(np.frombuffer(x["stretch"], np.int64), (m, 1)), *fixed, first.astype(np.int32), last.astype(np.int32), np.full(m, x["shift"], np.int32)])
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([binary_column(c) if c.ndim == 2 else pa.array(c) for c in columns], ["core", "hull", "stretch", "anchor", "key", "n", "first", "last", "shift"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for x in batch.to_pylist():
                content, start, end = kind.placed([x["data"]])
                for y in x["pieces"]:
                    data = content[start[y["first"]] : end[y["last"] + window - 1]]
                    yield x["anchor"], x["stretch"], y["core"], y["n"], y["many"], x["offset"] - y["first"], y["last"] - y["first"] + 1, x["shift"] + y["first"], data

    part = saved(members.mapInArrow(parts, "core bigint, hull binary, stretch binary, anchor bigint, key bigint, n bigint, first int, last int, shift int"), f"{name}-pieces")
    speaker = F.min(F.struct("anchor", "stretch", "key", "first", "last")).alias("at")
    hulls = saved(part.groupBy("core", "hull").agg(F.sum("n").alias("n"), speaker), f"{name}-different-pieces")
    # What occurs more than once has been found to repeat before, or is now.
    whole = part.where("n = 1").join(hulls.where("n > 1").select("core", "hull"), ["core", "hull"], "left_semi")
    whole = saved(whole.select("anchor", "stretch", (F.col("shift") + F.col("first")).alias("first"), (F.col("shift") + F.col("last")).alias("last")), f"{name}-whole-pieces")
    several = hulls.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core", (F.col("k") > GROUP).alias("many"))
    picked = hulls.join(several, "core").select("at.anchor", "at.stretch", "at.key", F.struct("core", "n", "many", "at.first", "at.last").alias("piece"))
    picked = picked.groupBy("anchor", "stretch", "key").agg(F.collect_list("piece").alias("pieces"))
    after = members.drop("n", "many").join(picked, ["anchor", "stretch", "key"])
    after = saved(after.mapInArrow(lambda b: _batches(cut(b), SHARED_NAMES, SHARED_TYPES), SHARED), f"{name}-finer")
    for x in (part, hulls):
        dropped(x)
    return whole, after


def repeated(docs: DataFrame, kind: Kind, method: Callable[[list, list[int], list[int]], list[np.ndarray]], name: str) -> DataFrame:
    """(row, spans array<struct<start, end>>): for each row of docs (row bigint, text binary) that has any, the symbols that repeated windows cover.

    method: from stretches, their numbers of windows and their groups, sorted by group, the starts of the windows that occur twice among them.
    Spans may touch or overlap. Everything between the steps is written to the shared folder.
    """
    table = saved(_anchor_table(docs, kind), f"{name}-anchors")
    # A stretch's first occurrence speaks for all.
    speaker = F.min(F.struct("row", "first", "last", "place")).alias("at")
    groups = saved(table.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), speaker), f"{name}-stretches")
    classes = saved(groups.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("k")).where("total > 1"), f"{name}-anchors-twice")
    some = groups.join(classes, "anchor")
    several = saved(some.where("k > 1").select("anchor", "stretch", "n", (F.col("k") > GROUP).alias("many"), "at.*"), f"{name}-several")
    shared = saved(_stretches(docs, several, kind), f"{name}-shared")
    # A stretch that occurs twice repeats as a whole.
    whole = some.where("n > 1").select("anchor", "stretch", F.lit(0).alias("first"), (F.col("at.last") - F.col("at.first")).alias("last"))
    found, few, many, step = [whole], [shared.where("not many")], shared.where("many"), kind.window - kind.gram + 1
    while step > 1 and not many.isEmpty():
        step = -(-step // PIECES)
        pieces, finer = _cut_finer(many, kind, step, name)
        found.append(pieces)
        few.append(finer.where("not many"))
        many = finer.where("many")
    few = functools.reduce(DataFrame.unionByName, few)
    total = few.agg(F.sum(F.octet_length("data")).alias("s")).first()["s"] or 0
    buckets = int(total // BUCKET_BYTES) * 2 + 1
    unpack = kind.unpack

    def shard(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("stretch", "ascending")])
        starts = method([unpack(x) for x in group.column("data").to_pylist()], group.column("windows").to_pylist(), group.column("key").to_pylist())
        wanted, shift = group.column("n").to_numpy() == 1, group.column("shift").to_numpy()
        at, first, last = [], [], []
        for i, s in enumerate(starts):
            if len(s) and wanted[i]:
                ends = np.r_[np.flatnonzero(np.diff(s) != 1), len(s) - 1]
                at.append(np.full(len(ends), i))
                first.append(s[np.r_[0, ends[:-1] + 1]] + shift[i])
                last.append(s[ends] + shift[i])
        flat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return group.select(["anchor", "stretch"]).take(pa.array(flat(at, np.int64))).append_column("first", pa.array(flat(first, np.int32))).append_column("last", pa.array(flat(last, np.int32)))

    dealt = few.select("anchor", "stretch", "key", "n", "windows", "shift", "data", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    found.append(saved(dealt.groupBy("bucket").applyInArrow(shard, FOUND), f"{name}-found"))
    verdicts = functools.reduce(DataFrame.unionByName, found).select("anchor", "stretch", F.struct("first", "last").alias("range"))
    hits = table.select("row", "anchor", "stretch", F.col("first").alias("at")).join(verdicts, ["anchor", "stretch"])
    span = F.struct((F.col("at") + F.col("range.first")).cast("int").alias("start"), (F.col("at") + F.col("range.last") + kind.window).cast("int").alias("end"))
    return hits.select("row", span.alias("span")).groupBy("row").agg(F.collect_list("span").alias("spans"))


def span_lists(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The starts and ends of each row's spans, none for null."""
    spans = column.flatten()
    start, end = spans.field("start").to_numpy(), spans.field("end").to_numpy()
    bounds = np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
    for a, b in zip([0, *bounds[:-1]], bounds, strict=True):
        yield start[a:b], end[a:b]


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n symbols the spans cover."""
    if not len(start):
        return np.zeros(n, bool)
    return np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0


def named(out: DataFrame, docs: DataFrame, key_col: str, id_col: str) -> DataFrame:
    """out with the documents' ids instead of their row keys."""
    if key_col == id_col:
        return out.withColumnRenamed("row", id_col)
    names = docs.select(F.col(key_col).alias("row"), F.struct(F.col(id_col).alias("id")).alias("name"))
    return out.join(names, "row").select(F.col("name.id").alias(id_col), *(c for c in out.columns if c != "row"))
