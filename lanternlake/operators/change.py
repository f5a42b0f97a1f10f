"""Change intelligence: symbol differences between versions, bounded reach in the dependency graph, impacted APIs and services."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanternlake.functions import text as X
from lanternlake.storage import bucketed, checkpointed, dealt, kept

#: Kinds of symbols whose changed signature is a modification, not a removal and an addition (fixed values).
MEMBER_KINDS = ("Method", "Constructor", "Property", "Field")


def symbol_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """(symbol_id, change): added, removed, or modified where the declaration's hash differs, null being a value."""
    b = base.select("symbol_id", F.col("declaration_hash").alias("old"), F.lit(True).alias("in_base"))
    t = target.select("symbol_id", F.col("declaration_hash").alias("new"), F.lit(True).alias("in_target"))
    both = b.join(t, "symbol_id", "full_outer")
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_target").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select("symbol_id", change.alias("change")).where("change is not null")


def reclassify(diff: DataFrame, base: DataFrame, target: DataFrame) -> DataFrame:
    """(symbol_id, change) of a diff in which the k-th removed and the k-th added member of one kind, name and type are one modified symbol."""
    key = ["kind", "name", "declaring"]
    w = Window.partitionBy(*key).orderBy("symbol_id")

    def side(change: str, symbols: DataFrame) -> DataFrame:
        own = diff.where(F.col("change") == change).select("symbol_id").join(symbols.where(F.col("kind").isin(*MEMBER_KINDS)).select("symbol_id", "kind", "name", X.declaring_type(F.col("fqn")).alias("declaring")), "symbol_id")
        return own.withColumn("n", F.row_number().over(w))

    pairs = side("removed", base).select(*key, "n", F.col("symbol_id").alias("gone")).join(side("added", target).select(*key, "n", F.col("symbol_id").alias("come")), [*key, "n"])
    moved = pairs.select(F.col("gone").alias("symbol_id"), F.lit("gone").alias("as")).unionByName(pairs.select(F.col("come").alias("symbol_id"), F.lit("come").alias("as")))
    joined = diff.join(moved, "symbol_id", "left").where("as is null or as = 'come'")
    return joined.select("symbol_id", F.when(F.col("as") == "come", "modified").otherwise(F.col("change")).alias("change"))


def changed_symbols(diff: DataFrame) -> DataFrame:
    """(symbol_id, change), one row a symbol: added before removed before modified."""
    order = F.when(F.col("change") == "added", 0).when(F.col("change") == "removed", 1).otherwise(2)
    return diff.groupBy("symbol_id").agg(F.min_by("change", order).alias("change"))


def adjacency(edges: DataFrame, both_ways: bool = False) -> DataFrame:
    """Distinct (from_id, to_id), with the edges turned round if both_ways."""
    out = edges.select("from_id", "to_id").distinct()
    return out.unionByName(out.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))).distinct() if both_ways else out


def direct(nodes: DataFrame, edges: DataFrame, symbol: str, dependents: bool = False) -> DataFrame:
    """The known symbols that one depends on, or that depend on it, by name."""
    a, b = ("to_id", "from_id") if dependents else ("from_id", "to_id")
    ids = adjacency(edges).where(F.col(a) == symbol).select(F.col(b).alias("symbol_id"))
    return nodes.join(ids, "symbol_id", "left_semi").orderBy("fqn")


def by_name(nodes: DataFrame, by: str = "project") -> DataFrame:
    """nodes (symbol_id, name, ...) with place: their order by name in any case of letters, then by name and id, within each value of `by`."""
    order = Window.partitionBy(by).orderBy(F.collate("name", "UTF8_LCASE"), "name", "symbol_id")
    return nodes.withColumn("place", F.row_number().over(order))


def reach(seeds: DataFrame, edges: DataFrame, depth: int, nodes: DataFrame | None = None, by: str | None = None, both_ways: bool = False) -> DataFrame:
    """(symbol_id, level): what depends on the seeds (symbol_id) within `depth` steps, at the first level, seeds left out.

    Steps are joins, one a level, on the distinct edges, which are shuffled once and lie in buckets for all steps; each level leaves out what was reached
    before and is checkpointed, so that no level repeats those before it. nodes: only known symbols
    count. by: a column that seeds have too, so that many searches go side by side. both_ways: along the edges, too.
    """
    ways = edges.select(F.col("to_id").alias("symbol_id"), F.col("from_id").alias("next_id"))
    if both_ways:
        ends = F.array(F.struct("symbol_id", "next_id"), F.struct(F.col("next_id").alias("symbol_id"), F.col("symbol_id").alias("next_id")))
        ways = ways.select(F.explode(ends).alias("e")).select("e.*")
    # Null ids are no symbols.
    with bucketed(ways.where("symbol_id is not null"), "symbol_id") as back:
        return reached(seeds, back, depth, nodes, by)


def reached(seeds: DataFrame, back: DataFrame, depth: int, nodes: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """reach() along steps (symbol_id, next_id) that lie in buckets by symbol_id already, so that several searches share them."""
    keys = ["symbol_id"] + ([by] if by else [])
    seen = checkpointed(seeds.select(*keys).distinct().withColumn("level", F.lit(0)))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(back, "symbol_id").select(F.col("next_id").alias("symbol_id"), *keys[1:]).distinct()
        if nodes is not None:
            step = step.join(nodes.select("symbol_id"), "symbol_id", "left_semi")
        front = checkpointed(step.join(seen.select(*keys), keys, "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(front)
    return seen.where("level > 0").select(*keys, "level")


def laid_out(edges: DataFrame) -> DataFrame:
    """Distinct (from_id, to_id) without nulls, computed once and kept in buckets by to_id: who asks for the edges to a symbol doesn't shuffle them."""
    return kept(dealt(edges.select("from_id", "to_id").where("from_id is not null and to_id is not null"), "to_id").distinct(), "to_id")


def touching(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from or to one of the symbols."""
    left = edges.join(ids.select(F.col("symbol_id").alias("from_id")), "from_id", "left_semi")
    right = edges.join(ids.select(F.col("symbol_id").alias("to_id")), "to_id", "left_semi")
    return left.select("from_id", "to_id").unionByName(right.select("from_id", "to_id")).distinct()


def touching_once(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """touching() of distinct edges, as laid_out() has them: only those that don't lead to one of the symbols are shuffled, to ask whether they come from one."""
    to = ids.select(F.col("symbol_id").alias("to_id"))
    rest = edges.join(to, "to_id", "left_anti").join(ids.select(F.col("symbol_id").alias("from_id")), "from_id", "left_semi")
    return edges.join(to, "to_id", "left_semi").select("from_id", "to_id").unionByName(rest.select("from_id", "to_id"))


def induced(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between the symbols."""
    inside = edges.join(ids.select(F.col("symbol_id").alias("from_id")), "from_id", "left_semi")
    return inside.join(ids.select(F.col("symbol_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id").distinct()


def dependency_paths(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The edges between the seeds and all that is within `depth` steps of them in either direction."""
    around = reach(seeds, edges, depth, both_ways=True).select("symbol_id").unionByName(seeds.select("symbol_id")).distinct()
    return induced(around, edges)


def impacted_services(*symbols: DataFrame) -> DataFrame:
    """Distinct projects of the symbols, sorted."""
    return reduce(DataFrame.unionByName, [s.select("project") for s in symbols]).where("project is not null").distinct().orderBy("project")


def dependency_files(changed: DataFrame, impacted: DataFrame) -> DataFrame:
    return changed.select("file_path").unionByName(impacted.select("file_path")).where("file_path is not null").distinct()


def files_to_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, symbols): each changed file with the distinct names of its symbols, paths compared without leading slash and case."""
    s = symbols.select(X.normalized_path(F.col("file_path")).alias("p"), "fqn")
    return files.withColumn("p", X.normalized_path(F.col("path"))).join(s, "p", "left").groupBy("path").agg(F.array_sort(F.collect_set("fqn")).alias("symbols"))


def kind_histogram(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n"))


def change_identifier(base: Column, target: Column) -> Column:
    return F.when(base.isNull() & target.isNull(), F.lit("working-tree")).otherwise(F.concat(F.coalesce(base, F.lit("HEAD")), F.lit(".."), F.coalesce(target, F.lit("working-tree"))))
