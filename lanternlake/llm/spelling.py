"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary, and the form that each one stands for.

One inserted, deleted or replaced code point leaves a half of the shorter word intact. A pair belongs to the length s of its shorter word, and
to the place p of its edit, the first at which the two differ: if p is in the second half, both begin alike, and stand in one block of the forward
dictionary; if not, both end alike, and stand in one block of the reversed one. Blocks are read as ranges of sorted rows, and all that is found is
compared in full, but a block may hold a great part of the dictionary. Skewed blocks are therefore subdivided before they are read: the places lo to hi - 1 at
which the edit may be are halved, and with each half the words have a longer beginning or a longer end in common. With one place left only
one letter is open in words of length s, and two in those of s + 1, so this ends. As p is one place, each pair is found once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved
from .runs import whole_runs

#: Words of a block that are compared with one another; larger blocks are subdivided.
BLOCK = 64
#: Pairs that are compared at once, and code points of a word up to which words of several blocks are.
PAIRS, TOGETHER = 1 << 16, 48

PAIR = "a string, na bigint, b string, nb bigint"


def dictionary(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """(word, n) of the words (word) of a length and a number of occurrences; a null word is none."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _blocked(rows: DataFrame) -> DataFrame:
    """rows (word, n, s, lo, hi) with block: what words with an edit at lo to hi - 1 have in common, their beginning and, read backwards, their end."""
    end = F.greatest(F.col("s") - F.col("hi"), F.lit(0))
    # A place of 0 or less would count from the end.
    tail = F.when(end > 0, F.reverse(F.substr(F.col("word"), F.char_length("word") - end + 1, end))).otherwise(F.lit(""))
    return rows.withColumn("block", F.concat(F.substr(F.col("word"), F.lit(1), F.col("lo")), F.lit("\x00"), tail))


_BLOCK_KEY = ["s", "lo", "hi", "block"]


def edit_places(short: np.ndarray, long: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For pairs of words, rows of code points with zeros after their end, the first place at which they differ if they are one edit apart, else -1.

    longer: whether the second word has one more code point; otherwise both have as many.
    """
    m = np.arange(len(short))
    differs = short != long
    place = differs.argmax(1)
    shifted = short[:, :-1] != long[:, 1:]
    # After the place nothing differs: neither in step, the place itself left out, nor one code point behind.
    differs[m, place] = False
    shifted &= np.arange(shifted.shape[1]) >= place[:, None]
    return np.where(np.where(longer, ~shifted.any(1), ~differs.any(1)), place, -1)


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words as rows, with two zeros after the longest, and their lengths."""
    sizes = np.array([len(w) for w in words])
    out = np.zeros((len(words), int(sizes.max()) + 2), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out, sizes


def near_in(words: list[str], at: np.ndarray, n: np.ndarray, s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that are one edit apart with the edit at lo to hi - 1, within runs of n words from `at` on; s, lo and hi are the runs'."""
    codes, sizes = _matrix(words)
    run = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(at, n) + within
    partners = np.repeat(n, n) - within - 1
    ends = np.cumsum(partners)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    begin = 0
    while begin < len(row):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        k = partners[begin:stop]
        one = np.repeat(np.arange(begin, stop), k)
        step = np.arange(len(one)) - np.repeat(np.cumsum(k) - k, k) + 1
        a, b, of = row[one], row[one] + step, run[one]
        keep = np.minimum(sizes[a], sizes[b]) == s[of]
        a, b, of = a[keep], b[keep], of[keep]
        turned = sizes[a] > sizes[b]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        if len(a):
            wide = int(s[of].max()) + 3
            place = edit_places(codes[a, :wide], codes[b, :wide], sizes[b] > sizes[a])
            hit = (place >= lo[of]) & (place < hi[of])
            found.append((a[hit], b[hit]))
        begin = stop
    return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(2))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PAIR rows from sorted rows (s, lo, hi, mark, word, n): each run of equal keys is a block."""
    for t, at, size in whole_runs(batches, ["s", "lo", "hi", "mark"]):
        words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
        s, lo, hi = (t.column(c).to_numpy()[at] for c in ("s", "lo", "hi"))
        # Blocks of ordinary words together, each one of long words alone: rows are as wide as the longest word.
        usual = np.flatnonzero((s <= TOGETHER) & (size > 1))
        for some in [usual, *([k] for k in np.flatnonzero((s > TOGETHER) & (size > 1)))]:
            if len(some):
                pick = np.repeat(at[some], size[some]) + np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
                own = [words[k] for k in pick.tolist()]
                a, b = near_in(own, np.cumsum(size[some]) - size[some], size[some], s[some], lo[some], hi[some])
                yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in a.tolist()], pa.string()), pa.array(n[pick][a], pa.int64()), pa.array([own[k] for k in b.tolist()], pa.string()), pa.array(n[pick][b], pa.int64())], ["a", "na", "b", "nb"])


def near_words(known: DataFrame) -> DataFrame:
    """(a, na, b, nb): all pairs of words of a dictionary (word, n) that are one edit apart, a the shorter one if there is one; each pair once. Words are distinct and not empty."""
    size = F.char_length("word")
    classes = known.select("word", "n", F.explode(F.array(size, size - 1)).alias("s")).where("s > 0")
    half, over = F.floor(F.col("s") / 2).cast("int"), (F.col("s") + 1).cast("int")
    sides = F.array(F.struct(half.alias("lo"), over.alias("hi")), F.struct(F.lit(0).alias("lo"), half.alias("hi")))
    rows = classes.select("word", "n", F.col("s").cast("int").alias("s"), F.explode(sides).alias("at")).select("word", "n", "s", "at.lo", "at.hi").where("lo < hi")
    ready, more = [], True
    while more:
        rows = _blocked(rows)
        # A block has a pair only with a word of length s; counts are summed up before they are dealt.
        counts = rows.groupBy(_BLOCK_KEY).agg(F.count("*").alias("members"), F.max(F.when(F.char_length("word") == F.col("s"), 1)).alias("short"))
        counts = saved(counts.where("members > 1 and short = 1").drop("short"), "spelling-blocks")
        placed = saved(rows.join(counts, _BLOCK_KEY).drop("block"), "spelling-placed")
        dropped(counts)
        skewed = (F.col("members") > BLOCK) & (F.col("hi") - F.col("lo") > 1)
        ready.append(placed.where(~skewed).drop("members"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
        rows = placed.where(skewed).select("word", "n", "s", F.explode(parts).alias("at")).select("word", "n", "s", "at.lo", "at.hi")
        more = not rows.isEmpty()
    dealt = _blocked(functools.reduce(DataFrame.unionByName, ready)).repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY, "word")
    # Blocks whose marks agree by chance would be one run: pairs are compared in full, so that costs time only.
    return dealt.select("s", "lo", "hi", F.xxhash64("block").alias("mark"), "word", "n").mapInArrow(_compared, PAIR)


def variants(known: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a dictionary (word, n).

    n_near: how many of its words are one edit apart. form: of these the one with the largest n, the smallest in code-point order of equal ones, if
    that n is at least `ratio` times the word's; else null. root: where the forms lead in the end, the word itself if it has none. Chains are short,
    as n grows by `ratio` at each step. An empty dictionary gives no rows; words are distinct and not null, and rows with an n of null have no form.
    """
    known = saved(known.select("word", "n"), "spelling-dictionary")
    pairs = saved(near_words(known), "spelling-pairs")
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = pairs.select(F.explode(ways).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = saved(best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")), "spelling-best")
    judged = saved(known.join(best, "word", "left").withColumn("fits", F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False))), "spelling-judged")
    # Each round doubles how far a root is from its word.
    roots = saved(judged.where("fits").select("word", F.col("near").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = saved(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        dropped(roots)
        roots = then.drop("moved")
        if then.where("moved").isEmpty():
            break
    fits = lambda c: F.when(F.col("fits"), F.col(c))
    out = judged.join(roots, "word", "left")
    return out.select("word", fits("near").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), fits("near_n").alias("form_n"))


#: Letters of which words are made: runs of them (fixed values).
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(text: Column) -> Column:
    """The runs of letters of a text, A-Z in lower case; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(LETTERS), F.lit(0))
