"""Connected components of links by joins and sums alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each id that has a link to another, the smallest id that it reaches.

    Alternates large-star and small-star steps: every node hands its larger, then its other neighbours to the smallest one it
    knows, until each points at its component's smallest. Rounds grow with the logarithm of the longest path. Each round's
    links are written to the shared folder; the minima are too, so that both sides of the join that spreads them are dealt
    anew and a node with very many links can be split among tasks. Null ends and loops are passed over.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = saved(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u, v).distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "links-low")
        large = saved(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links-large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        new = _state(after)
        for old in (low, large, least, now):
            dropped(old)
        now = after
        if new == state:
            break
        state = new
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
