"""Merkle manifest of a table: checkpoint and recompute.

Every row is a leaf.  Leaves of a group ascend by key; two neighbours (or an odd
one left over, alone) become one node a level up, until one node, the subroot,
is left; subroots in the order of their groups are the leaves of one more tree,
whose last node is the root.  Of ``every`` levels only the last is written.  A
written node thus stands above an aligned subtree of at most ``2 ** every``
nodes of the level written before; proof extraction walks down from the root,
makes the missing interior nodes of one such subtree again from its written
descendants, hands each descendant its siblings and forgets them.

A group of rows may be any share of the table: positions come from a range sort
of the leaves, and a task holds one aligned subtree, never a whole group.

Digests are SHA-256 over hex text.  Defined cases: null fields are hashed as such;
the null group comes first, and null keys come first in a group; rows with equal keys are ordered by their leaves; a
group of one leaf has that leaf as its subroot, and one group's subroot is the root; an empty table has no
node and no proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.cells import store

#: Levels from one written level to the next, and leaves in a range of the sort.
EVERY = 10
RANGE_ROWS = 1 << 15

_STEP = 33  # bytes of a proof step: the side of the sibling and its digest
_ALONE, _LEFT, _RIGHT = b"-", b"<", b">"
_NODE_DDL = "grp string, pos long, n long, digest binary"


def field(value: Column) -> Column:
    """A field as it enters a leaf: ``-``, or its bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(f) for f in fields]), 256))


def _parent(a: bytes, b: bytes = b"") -> bytes:
    return hashlib.sha256((a.hex() + b.hex()).encode()).digest()


def _up(nodes: list[bytes]) -> list[bytes]:
    pairs = [_parent(a, b) for a, b in zip(nodes[::2], nodes[1::2])]
    return [*pairs, _parent(nodes[-1])] if len(nodes) % 2 else pairs


def _height(n: int, every: int) -> int:
    """Levels that one round climbs in a group with ``n`` nodes."""
    return min(every, (n - 1).bit_length())


def _steps(nodes: list[bytes]) -> list[bytes]:
    """The proof step of each node of a level."""
    out = []
    for i in range(len(nodes)):
        other = i ^ 1
        out.append(_ALONE + bytes(32) if other == len(nodes) else (_LEFT if other < i else _RIGHT) + nodes[other])
    return out


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a digest and its siblings give."""
    for at in range(0, len(path), _STEP):
        side, other = path[at : at + 1], path[at + 1 : at + _STEP]
        digest = _parent(digest) if side == _ALONE else _parent(other, digest) if side == _LEFT else _parent(digest, other)
    return digest


def siblings(path: bytes) -> list[bytes]:
    return [path[at + 1 : at + _STEP] for at in range(0, len(path), _STEP) if path[at : at + 1] != _ALONE]


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` plus ``pos`` (from 0) in their group and ``n``, the group's rows.  ``group`` holds no nulls.

    Rows are range-sorted by group and order, so a large group lies in many
    ranges; the rows of a group in a range lie side by side, and the earlier ranges shift them.
    """
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    at = F.monotonically_increasing_id()
    cut = rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    laid = store(cut.withColumn("_at", at).withColumn("_range", F.spark_partition_id()), "merkle-sorted")
    sizes = laid.groupBy("_range", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "_range", group, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("n"),
    )
    return laid.join(shifts, ["_range", group]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


@dataclass(frozen=True)
class Tree:
    """Written levels of one tree a group; ``levels[-1]`` has one node a group."""

    levels: list[DataFrame]
    every: int

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("grp", "digest")


def climb(leaves: DataFrame, every: int = EVERY) -> Tree:
    """A tree over ``grp, pos, n, digest``; each turn writes the level ``every`` above the last one."""

    def top(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        nodes, n = block["digest"].to_pylist(), block["n"][0].as_py()
        height = _height(n, every)
        for _ in range(height):
            nodes = _up(nodes)
        return pa.table({
            "grp": block["grp"][:1], "pos": pa.array([block["pos"][0].as_py() >> every], pa.int64()),
            "n": pa.array([-(-n >> every) if height == every else 1], pa.int64()), "digest": pa.array(nodes, pa.binary()),
        })

    levels = [leaves.select("grp", "pos", "n", "digest")]
    most = leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        blocks = levels[-1].groupBy("grp", F.shiftright("pos", every).alias("block"))
        levels.append(store(blocks.applyInArrow(top, _NODE_DDL), "merkle-level"))
        most = -(-most >> every)
    return Tree(levels, every)


def descend(tree: Tree, paths: DataFrame, kept: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``kept`` (rows of the lowest level, with any columns) plus their ``path`` to the root and the columns ``carry``.

    ``paths``: ``grp, path`` and ``carry`` for each tree of ``tree``: what is above its last node.
    """
    handed = _fields(paths, ("path", *carry))
    above = paths.select("grp", F.lit(0).cast("long").alias("pos"), "path", *carry)
    for k in range(len(tree.levels) - 2, -1, -1):
        below = tree.levels[k] if k else kept
        above = _hand_down(below, above, tree.every, handed, carry)
        if k:
            above = store(above.select("grp", "pos", "path", *carry), "merkle-paths")
    if len(tree.levels) == 1:  # every tree is a lone leaf
        above = kept.join(above.drop("pos"), "grp")
    return above


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{name} {df.schema[name].dataType.simpleString()}" for name in names)


def _hand_down(below: DataFrame, above: DataFrame, every: int, handed: str, carry: Sequence[str]) -> DataFrame:
    def expand(children: pa.Table, parent: pa.Table) -> pa.Table:
        children = children.sort_by("pos")
        nodes = children["digest"].to_pylist()
        steps = []
        for _ in range(_height(children["n"][0].as_py(), every)):
            steps.append(_steps(nodes))
            nodes = _up(nodes)
        rest = parent["path"][0].as_py()
        own = [b"".join([*(level[i >> k] for k, level in enumerate(steps)), rest]) for i in range(len(children))]
        out = children.drop_columns(["block"]).append_column("path", pa.array(own, pa.binary()))
        first = pa.array(np.zeros(len(children), np.int64))
        for name in carry:
            out = out.append_column(name, parent[name].take(first))
        return out

    left = below.withColumn("block", F.shiftright("pos", every))
    right = above.withColumnRenamed("pos", "block")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in below.schema) + ", " + handed
    return left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInArrow(expand, schema)


@dataclass(frozen=True)
class Manifest:
    """Placed leaves and their trees, placed subroots and the tree over them."""

    leaves: DataFrame
    trees: Tree
    subroots: DataFrame
    top: Tree


def manifest(leaves: DataFrame, every: int = EVERY) -> Manifest:
    """The written levels over ``key, grp, digest`` (``grp`` a string or null) and any other columns, which the leaves keep.

    In the manifest ``grp`` is a string without nulls that sorts like the given one.
    """
    named = F.when(F.col("grp").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("grp")))
    placed = store(positions(leaves.withColumn("grp", named), "grp", ("key", "digest")), "merkle-leaves")
    trees = climb(placed, every)
    tops = trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("tree"), "digest")
    subroots = store(positions(tops, "grp", ("tree",)), "merkle-subroots")
    return Manifest(placed, trees, subroots, climb(subroots, every))


def proofs(made: Manifest) -> DataFrame:
    """The placed leaves plus ``path`` (the steps from the leaf to the root), ``subroot`` and ``root``."""
    root = made.top.roots.select("grp", F.lit(b"").alias("path"), F.col("digest").alias("root"))
    tops = descend(made.top, root, made.subroots, ("root",))
    above = tops.select(F.col("tree").alias("grp"), "path", F.col("digest").alias("subroot"), "root")
    return descend(made.trees, store(above, "merkle-tops"), made.leaves, ("subroot", "root"))
