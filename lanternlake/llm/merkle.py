"""Merkle manifest of a table: a tree of digests over the rows of each group, and one over the groups.

The trees are built by a sparse-forest monoid. A forest holds the nodes that wait for their siblings, keyed by group, level and
index. As a group's size is known, so is how many siblings each run has; a run that is complete becomes its parent. Forests
can be merged in any order and in any grouping, so each partition first closes what it can of its own rows, and what stays open
is merged in a tree of rounds, each over blocks of 512 times as many rows. Neighbours meet first, so a round's forests stay
small, and nothing passes through the driver.

Proofs go the other way, from the root down: a block of rows gets the path of its own node, and adds the siblings inside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, saved

#: Levels that a block of siblings spans: one block is arity**STRIP nodes of a level and what is above them, up to the node over all.
STRIP = 3

NODE = "g bigint, n bigint, level int, i bigint, digest string, open boolean"
_NODE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
STEP = "struct<left: string, right: string>"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def nodes_at(n: int, level: int, arity: int) -> int:
    """How many nodes a tree over n leaves has at a level."""
    return -(-n // arity**level)


def depth_of(n: int, arity: int) -> int:
    """Levels above the leaves: 0 for a lone leaf, which is its own root."""
    level = 0
    while nodes_at(n, level, arity) > 1:
        level += 1
    return level


class Forest:
    """Nodes that wait for siblings. put() and merge() may come in any order; made: the parents that came of complete runs."""

    def __init__(self, arity: int):
        self.arity, self.open, self.made = arity, {}, []

    def put(self, g: int, n: int, level: int, i: int, digest: str) -> None:
        """Adds a node; if it completes its run of siblings, the run becomes its parent, and so on to the root."""
        while (count := nodes_at(n, level, self.arity)) > 1:
            run = i // self.arity
            held = self.open.setdefault((g, n, level, run), {})
            held[i] = digest
            if len(held) < min(self.arity, count - run * self.arity):
                return
            del self.open[g, n, level, run]
            level, i, digest = level + 1, run, digest_of("".join(held[k] for k in sorted(held)))
            self.made.append((g, n, level, i, digest, False))

    def merge(self, other: Forest) -> Forest:
        for (g, n, level, _), held in other.open.items():
            for i, digest in held.items():
                self.put(g, n, level, i, digest)
        self.made += other.made
        return self

    def taken(self) -> list[tuple]:
        """The parents made since the last call, as rows of NODE."""
        out, self.made = self.made, []
        return out

    def waiting(self) -> list[tuple]:
        return [(g, n, level, i, digest, True) for (g, n, level, _), held in self.open.items() for i, digest in held.items()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, _NODE_TYPES, strict=True)], [x.split(" ")[0] for x in NODE.split(", ")])


def forest(leaves: DataFrame, largest: int, arity: int, name: str) -> DataFrame:
    """(g, n, level, i, digest) of all nodes above the leaves (g bigint, n bigint, i bigint, leaf string), of groups of n leaves each; largest: the largest n."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Forest(arity)
        for batch in batches:
            for g, n, i, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.put(g, n, 0, i, leaf)
            yield _rows(held.taken())
        yield _rows(held.waiting())

    def merged(table: pa.Table) -> pa.Table:
        held = Forest(arity)
        for g, n, level, i, digest in zip(*(table.column(c).to_pylist() for c in ("g", "n", "level", "i", "digest")), strict=True):
            held.put(g, n, level, i, digest)
        return pa.Table.from_batches([_rows(held.taken() + held.waiting())])

    now = saved(leaves.select("g", "n", "i", "leaf").sortWithinPartitions("g", "i").mapInArrow(own, NODE), f"{name}-nodes")
    done, block = [now.where("not open")], 1
    while block < largest:
        block *= arity**STRIP
        # All that is below a node of this block is in it: its run completes here at the latest.
        power = F.element_at(F.array(*(F.lit(arity**k) for k in range(depth_of(largest, arity) + 1))), F.col("level") + 1)
        dealt = now.where("open").withColumn("block", F.floor(F.col("i") * power / F.lit(block)).cast("long"))
        now = saved(dealt.groupBy("g", "block").applyInArrow(merged, NODE), f"{name}-nodes")
        done.append(now.where("not open"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open")


def _steps(digests: list[str], levels: int, arity: int) -> tuple[list[list[tuple[str, str]]], list[str]]:
    """For each level of a block the (left, right) siblings of each node, and the nodes that are left above."""
    out = []
    for _ in range(levels):
        runs = [digests[a : a + arity] for a in range(0, len(digests), arity)]
        out.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
        digests = [digest_of("".join(run)) for run in runs]
    return out, digests


def folded_in(digest: str, steps) -> str:
    """The root that follows from a digest and its steps (left, right)."""
    for left, right in steps:
        digest = digest_of(left + digest + right)
    return digest


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its proof, as columns: what a reader of a manifest compares with the root."""
    return F.aggregate(steps, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def _depth(n: Column, arity: int) -> Column:
    powers = [arity**k for k in range(64) if arity**k < 2**62]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda x: x < n))


def _block(i: str, arity: int) -> Column:
    return F.floor(F.col(i) / F.lit(arity**STRIP)).cast("long").alias("block")


def _paths(nodes: DataFrame, above: DataFrame, largest: int, arity: int, name: str) -> DataFrame:
    """(g, block, path): the steps from each block of leaves to the root. above: (g, depth, path), the steps from each group's own root on."""

    def spread(key, mine: pa.Table, over: pa.Table) -> pa.Table:
        mine, path = mine.sort_by("i"), over.column("path").to_pylist()[0]
        digests = mine.column("digest").to_pylist()
        levels = min(STRIP, depth_of(mine.column("n")[0].as_py(), arity) - mine.column("level")[0].as_py())
        steps, _ = _steps(digests, levels, arity)
        paths = [[{"left": s[k // arity**j][0], "right": s[k // arity**j][1]} for j, s in enumerate(steps)] + path for k in range(len(digests))]
        return pa.table({"g": mine.column("g"), "block": mine.column("i"), "path": pa.array(paths, over.schema.field("path").type)})

    carried = None
    for low in range(depth_of(largest, arity) // STRIP * STRIP, -1, -STRIP):
        # Groups whose root is in this strip take their path from above, the others from the strip over it.
        begun = above.where((F.col("depth") > low) & (F.col("depth") <= low + STRIP) | (F.col("depth") == 0) & F.lit(low == 0)).select("g", F.lit(0).cast("long").alias("block"), "path")
        carried = begun if carried is None else carried.unionByName(begun)
        if low:
            level = nodes.where(F.col("level") == low).select("g", "n", "level", "i", "digest", _block("i", arity)).where(_depth(F.col("n"), arity) > low)
            carried = saved(level.groupBy("g", "block").cogroup(carried.groupBy("g", "block")).applyInArrow(_matched(spread, f"g bigint, block bigint, path array<{STEP}>"), f"g bigint, block bigint, path array<{STEP}>"), f"{name}-paths")
    return carried


def _matched(f, schema: str):
    """f for blocks that both sides have; the other ones give no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(key, mine: pa.Table, over: pa.Table) -> pa.Table:
        return f(key, mine, over).cast(arrow) if mine.num_rows and over.num_rows else arrow.empty_table()

    return run


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of columns one after the other, each - for null or else its bytes' number, a colon and its value as text in UTF-8."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)).cast("binary"), 256)


def _placed(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows (name string, ...) in order of name and order, with their partition and place, written; and (name, part, first, before, n) of each partition's part of a group."""
    rows = saved(rows.orderBy("name", *order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), f"{name}-ordered")
    parts = rows.groupBy("name", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    # As many rows as partitions and groups.
    w = Window.partitionBy("name")
    parts = parts.withColumn("n", F.sum("k").over(w)).withColumn("before", F.coalesce(F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows, parts.drop("k")


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", arity: int = 8, changed: dict[str, Column] | None = None, steps: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified[, steps]) of each row.

    A row's leaf is the digest of `columns` (see leaf_digest()). A group's leaves, in order of id, null first, then of leaf, are hashed in runs
    of `arity` up to one node, the subroot; the subroots, in order of group, null first, likewise up to the root. steps: the proof, an
    array of (left, right) siblings from the leaf up; proof_sha256 is of all of them joined. folded_root follows from these steps and the leaf that
    the row has with the columns in `changed` put in place of its own, and verified is whether it is the root; what is null in place of a
    null stays null. Repeated rows are leaves of their own; rows with equal ids follow one another in order of leaf. An empty table
    gives no rows. Columns other than those named are not read.
    """
    own = [F.col(c) for c in columns]
    other = [(changed or {}).get(c, F.col(c)) for c in columns]
    group = F.col(group_col).cast("string")
    # The empty name is the null group's; all others begin with a sign, so it comes first.
    named = docs.select(F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("name"), F.col(id_col).alias("id"), leaf_digest(own).alias("leaf"), (leaf_digest(other) if changed else leaf_digest(own)).alias("changed"))
    rows, parts = _placed(named, ["id", "leaf"], "merkle")
    groups, group_parts = _placed(parts.groupBy("name").agg(F.max("n").alias("n")).select(F.lit("").alias("name"), F.col("name").alias("group"), F.col("n").alias("size")), ["group"], "merkle-groups")
    group_rows = groups.join(group_parts, ["name", "part"]).select(F.lit(0).cast("long").alias("g"), "n", (F.col("before") + F.col("at") - F.col("first")).alias("i"), "group", "size")
    group_rows = saved(group_rows, "merkle-groups-placed")
    bounds = group_rows.agg(F.max("size").alias("rows"), F.max("n").alias("groups")).first()
    most, n_groups = bounds["rows"] or 1, bounds["groups"] or 1
    of_group = group_rows.select(F.col("group").alias("name"), F.col("i").alias("g"))
    place = parts.join(of_group, "name")
    leaves = saved(rows.join(place, ["name", "part"]).select("g", "n", (F.col("before") + F.col("at") - F.col("first")).alias("i"), "id", "leaf", "changed"), "merkle-leaves")
    dropped(rows)
    nodes = forest(leaves, most, arity, "merkle")
    tops = nodes.where(F.col("level") == _depth(F.col("n"), arity)).select("g", "digest").unionByName(leaves.where("n = 1").select("g", F.col("leaf").alias("digest")))
    roots = group_rows.withColumnRenamed("g", "all").withColumnRenamed("i", "g").join(tops, "g").select(F.col("all").alias("g"), "n", F.col("g").alias("i"), F.col("digest").alias("leaf"))
    roots = saved(roots, "merkle-subroots")
    upper = forest(roots, n_groups, arity, "merkle-upper")
    nothing = F.array().cast(f"array<{STEP}>")
    start = roots.select("g", _depth(F.col("n"), arity).alias("depth"), nothing.alias("path")).limit(1)
    over = _paths(upper, start, n_groups, arity, "merkle-upper")

    def lifted(key, mine: pa.Table, over: pa.Table) -> pa.Table:
        mine, path = mine.sort_by("i"), over.column("path").to_pylist()[0]
        digests = mine.column("leaf").to_pylist()
        inside, _ = _steps(digests, min(STRIP, depth_of(mine.column("n")[0].as_py(), arity)), arity)
        paths = [[{"left": s[k // arity**j][0], "right": s[k // arity**j][1]} for j, s in enumerate(inside)] + path for k in range(len(digests))]
        return pa.table({"g": mine.column("i"), "path": pa.array(paths, over.schema.field("path").type)})

    group_paths = roots.withColumn("block", _block("i", arity)).groupBy("g", "block").cogroup(over.groupBy("g", "block")).applyInArrow(_matched(lifted, f"g bigint, path array<{STEP}>"), f"g bigint, path array<{STEP}>")
    above = saved(group_rows.select(F.col("i").alias("g"), _depth(F.col("size"), arity).alias("depth")).join(group_paths, "g"), "merkle-above")
    blocks = _paths(nodes, above, most, arity, "merkle")
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, steps array<{STEP}>"

    def proved(key, mine: pa.Table, over: pa.Table) -> pa.Table:
        mine = mine.sort_by("i")
        path = [(x["left"], x["right"]) for x in over.column("path").to_pylist()[0]]
        depth = depth_of(mine.column("n")[0].as_py(), arity)
        digests, changed_leaves = mine.column("leaf").to_pylist(), mine.column("changed").to_pylist()
        inside, top = _steps(digests, min(STRIP, depth), arity)
        subroot = folded_in(top[0], path[: depth - len(inside)])
        root, rest = folded_in(subroot, path[depth - len(inside) :]), "".join(a + b for a, b in path)
        proofs, ends, all_steps = [], [], []
        for k, (leaf, now) in enumerate(zip(digests, changed_leaves, strict=True)):
            low = [s[k // arity**j] for j, s in enumerate(inside)]
            proofs.append(digest_of("".join(a + b for a, b in low) + rest))
            ends.append(root if now == leaf else folded_in(now, [*low, *path]))
            all_steps.append([{"left": a, "right": b} for a, b in [*low, *path]] if steps else None)
        m = len(digests)
        return pa.table([mine.column("id"), mine.column("leaf"), pa.array([subroot] * m), pa.array([root] * m), pa.array(proofs), pa.array(ends), pa.array([x == root for x in ends]), pa.array(all_steps, over.schema.field("path").type)], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "steps"])

    out = leaves.withColumn("block", _block("i", arity)).groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(_matched(proved, schema), schema)
    out = out.withColumnRenamed("id", id_col)
    return out if steps else out.drop("steps")
