"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within its source the keys are put in order and sizes summed up along
that order; a source's target then cuts at the exact word. The order is dealt into ranges of keys, so that no
task holds a source: sums of ranges, sums of blocks of ranges, and last the rows within a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, saved, with_rows

#: Documents that a range of keys holds on average, and ranges in a block.
RANGE_ROWS, BLOCK_RANGES = 256, 1024
#: A list of sources up to this long is sent to all tasks; a longer one is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: The sources' weights in order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def text_size(text_col: str = "text") -> F.Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _filled(sources: DataFrame, ratio: float, most: float) -> DataFrame:
    """Adds weight and target to (null_source, source_key, source_size, ...): the level up to which all sources are filled by weight, each to its cap at most.

    Sources reach their caps in the order of cap over weight. Before each of them, what the capped ones hold and the weight
    of the rest give the level that the rest would reach; the first one that this level doesn't fill sets the level for all after it.
    """
    # One row a source: this table is as long as the list of sources, whatever the documents.
    n = F.row_number().over(Window.orderBy("null_source", "source_key"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(n - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    w = sources.withColumn("weight", weight).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "null_source", "source_key")
    every = Window.partitionBy()
    w = (
        w.withColumn("wanted", F.lit(float(ratio)) * F.sum("source_size").over(every))
        .withColumn("held", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("held")) / F.col("rest"))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    )
    level = F.max(F.when(F.col("open"), F.col("level"))).over(every)
    return w.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))).drop("wanted", "held", "rest", "level", "open", "cap")


def mix(sized: DataFrame, ratio: float = 1.5, most: float = 2.0, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row of (id, source, size).

    The sources share ratio times all sizes by weight (WEIGHTS in order of code point, null last); a source's target stops
    at most times its size, what is over goes to the others by weight. taken: words of the row that the mix takes. A source's
    whole epochs take all of it, the last part of an epoch the rows of the least keys, the one at the cut in part. Keys are
    hashes of the id, so reruns agree; rows with equal ids and sizes follow one another and are as good as each other.
    Sizes that are null count as 0; an empty table gives no rows; a source without words has target 0. Other columns are dropped.
    """
    rows = sized.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"),
        F.col(source_col).isNull().alias("null_source"), F.coalesce(F.col(source_col), F.lit("")).alias("source_key"),
        F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long").alias("key"),
    )
    rows = saved(rows, "mix-rows")
    key = ["null_source", "source_key"]
    sources = saved(_filled(rows.groupBy(key).agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / RANGE_ROWS).alias("n_ranges")), ratio, most), "mix-sources")
    small = sources.count() <= BROADCAST_SOURCES
    placed = rows.join(F.broadcast(sources) if small else sources, key)
    # Which range a key is in: the 2**60 keys are cut into n_ranges even ranges.
    place = F.floor(F.col("key") / F.lit(2.0**60) * F.col("n_ranges"))
    placed = placed.withColumn("range", F.least(place, F.col("n_ranges") - 1).cast("long"))
    sums = placed.groupBy(*key, "range").agg(F.sum("size").alias("range_size")).withColumn("block", F.floor(F.col("range") / BLOCK_RANGES))
    before = Window.unboundedPreceding, -1
    blocks = sums.groupBy(*key, "block").agg(F.sum("range_size").alias("block_size"))
    blocks = blocks.withColumn("block_at", F.coalesce(F.sum("block_size").over(Window.partitionBy(*key).orderBy("block").rowsBetween(*before)), F.lit(0))).drop("block_size")
    ranges = sums.join(blocks, [*key, "block"]).withColumn("range_at", F.col("block_at") + F.coalesce(F.sum("range_size").over(Window.partitionBy(*key, "block").orderBy("range").rowsBetween(*before)), F.lit(0)))
    within = Window.partitionBy(*key, "range").orderBy("key", "id", "size").rowsBetween(*before)
    at = placed.join(ranges.select(*key, "range", "range_at"), [*key, "range"]).withColumn("at", F.col("range_at") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    cut = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    taken = whole * F.col("size") + F.least(F.col("size"), F.greatest(cut - F.col("at"), F.lit(0)))
    return at.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, ratio: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus in the columns of docs: each document as often as the mix takes it whole, and once more in part where it is cut.

    The part keeps the first words with the white space before them; all other columns stay. Documents of which nothing is taken are
    left out, and so are those without a word. Rows with equal or null ids are rows of their own.
    """
    rows, key_col = with_rows(docs, id_col)
    sized = rows.select(F.col(key_col).alias("key"), F.col(source_col).alias("source"), text_size(text_col).alias("size"))
    taken = mix(sized, ratio, most, "key", "source", "size").where(F.col("taken") > 0).select(F.struct("key", "size", "taken").alias("mix"))
    joined = rows.select(F.struct("*").alias("whole")).join(taken, F.col(f"whole.{key_col}") == F.col("mix.key"))
    size, n = F.col("mix.size"), F.col("mix.taken")
    left = F.pmod(n, size)
    parts = joined.withColumn("part", F.explode(F.sequence(F.lit(1), F.ceil(n / size).cast("int"))))
    text = F.col(f"whole.{text_col}")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), left.cast("int")), "")
    shown = F.when((F.col("part") * size > n) & (left > 0), head).otherwise(text)
    return parts.select(*(shown.alias(c) if c == text_col else F.col(f"whole.{c}").alias(c) for c in docs.columns))
