"""Merkle manifest of a data set, with a proof for every row.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as hex text. A row's leaf
is H of its fields, each `-` if null, else its UTF-8 byte count, a colon and the value. The rows of
a group (a source) ascend by their order columns and are leaves of the group's tree; while a tree
has several nodes, every `fan` consecutive ones, and the fewer that are left over at the end, become
their H. What remains is the group's subroot. The subroots, in the order of the groups (null first,
UTF-8 bytewise), are the leaves of one more tree, whose top is the root.

Bottom up, every level is written to the shared folder: a node holds its place, its digest and the
run of its children. Top down, a node's path (the siblings on its way to the root) is joined with
the run it stands for, and each child gets its own siblings put before that path. A join has a row
for each node of a level, keys are spread by a run's size, and so a group of any size is split.

Nulls: a null field is `-`; rows of the null group form a group; null order columns come first.
Rows with equal order columns are ordered by their leaves; equal rows are leaves of their own and
interchangeable. An empty table has no rows, no root and no proofs. Other columns are ignored
unless they are named.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stage
from waymark.operators.ranks import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a path: the siblings before and after a node, concatenated.
STEP = "struct<left:string,right:string>"


def leaf(fields: dict[str, Column] | list[str]) -> Column:
    """The digest of a row's fields, in their order."""
    columns = list(fields.values()) if isinstance(fields, dict) else [F.col(c) for c in fields]

    def framed(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(framed, columns)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path of siblings lead to."""
    return F.aggregate(path, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def raised(leaves: DataFrame, fan: int, tag: str) -> list[DataFrame]:
    """The staged levels over leaves (tree, at, n, digest, payload), these first.

    at is a node's place in its level of its tree, n how many nodes that level has; a node above
    the leaves has the run of its children instead of a payload. A tree ends where n is 1.
    """
    levels = [leaves]
    while not (below := levels[-1].filter("n > 1")).isEmpty():
        child = F.struct("at", "digest", *(["payload"] if len(levels) == 1 else []))
        runs = below.groupBy("tree", F.expr(f"at div {fan}").alias("at")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(child)).alias("run"))  # at most `fan` children
        digest = F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256)
        nodes = runs.select("tree", "at", F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), digest.alias("digest"), "run")
        levels.append(stage(nodes, f"{tag}-{len(levels)}"))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """tree and digest of every tree's last node."""
    return reduce(DataFrame.union, (level.filter("n = 1").select("tree", "digest") for level in levels))


def pushed(levels: list[DataFrame], inherited: DataFrame) -> DataFrame:
    """tree, digest, payload, subroot and path of all leaves; inherited: tree, subroot and path of the trees' tops."""

    def start(level: DataFrame) -> DataFrame:  # a tree's top has what the tree has
        return level.filter("n = 1").select("tree", "at").join(inherited, "tree")

    paths = start(levels[-1])
    for k in range(len(levels) - 1, 0, -1):
        runs = levels[k].select("tree", "at", "run").join(paths, ["tree", "at"])
        children = runs.select("tree", F.col("at").alias("above"), "run", "subroot", "path", F.posexplode("run").alias("place", "own"))
        beside = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["digest"]), "")
        step = F.struct(beside(lambda _, i: i < F.col("place")).alias("left"), beside(lambda _, i: i > F.col("place")).alias("right"))
        path = F.concat(F.array(step), F.col("path")).alias("path")
        if k == 1:
            below = children.select("tree", "own.digest", "own.payload", "subroot", path)
            lone = levels[0].filter("n = 1").join(inherited, "tree").select("tree", "digest", "payload", "subroot", "path")
            return below.union(lone)
        paths = children.select("tree", F.col("own.at").alias("at"), "subroot", path).union(start(levels[k - 1]).select("tree", "at", "subroot", "path"))
    return levels[0].join(inherited, "tree").select("tree", "digest", "payload", "subroot", "path")


@dataclass
class Manifest:
    """levels: the written levels of the groups' trees; top: those of the tree over their subroots."""

    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    fan: int

    def subroots(self) -> DataFrame:
        """tree and digest of each group, in the order of the groups."""
        return tops(self.levels)

    def proofs(self) -> DataFrame:
        """The kept columns of every row, with leaf, subroot, root and path."""
        none = F.lit(None).cast(f"array<{STEP}>")
        start = self.top[0].sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit("").alias("subroot"), F.coalesce(none, F.array().cast(f"array<{STEP}>")).alias("path"))
        upper = pushed(self.top, start).select("payload.tree", F.col("digest").alias("subroot"), "path")
        found = pushed(self.levels, stage(upper, "merkle-upper"))
        return found.select("payload.*", F.col("digest").alias("leaf"), "subroot", F.lit(self.root).alias("root"), "path")


def build(rows: DataFrame, by: str, order: list[str], leaf: Column, keep: dict[str, Column], fan: int = 3) -> Manifest:
    """The manifest of rows, grouped by a column and ordered by others; keep: what proofs carry of each row, of types with an order."""
    kept = F.struct(*(c.alias(name) for name, c in keep.items()))
    sort = [F.col("by").asc_nulls_first(), *(F.col(f"o{k}").asc_nulls_first() for k in range(len(order))), F.col("digest")]
    flat = rows.select(F.col(by).alias("by"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), leaf.alias("digest"), kept.alias("payload"))
    placed = numbered(flat, sort, "rank")
    trees = stage(placed.groupBy("by").agg(F.min("rank").alias("tree"), F.count("*").alias("n")), "merkle-trees")  # a row a group
    own = placed.join(trees, placed["by"].eqNullSafe(trees["by"]))
    leaves = stage(own.select("tree", (F.col("rank") - F.col("tree")).alias("at"), "n", "digest", "payload"), "merkle-leaves")
    levels = raised(leaves, fan, "merkle")
    groups = numbered(tops(levels), [F.col("tree")], "rank")  # a tree is named by the rank of its first row
    n = groups.count()
    upper = groups.select(F.lit(0).cast("long").alias("tree"), (F.col("rank") - 1).alias("at"), F.lit(n).cast("long").alias("n"), "digest", F.struct("tree").alias("payload"))
    top = raised(stage(upper, "merkle-groups"), fan, "merkle-top")
    found = tops(top).first()
    return Manifest(levels, top, found["digest"] if found else None, fan)
