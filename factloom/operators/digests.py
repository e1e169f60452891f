"""Digests of subtrees, folded from the deepest level up: equal trees have equal roots, and what differs is found by descending only where digests differ."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lineage


@dataclass
class DigestTree:
    """levels[d]: prefix, next_token, numleaves and below (the digest of what hangs under the edge; null under a leaf) of the edges at depth d. root: the digest of the whole tree."""

    levels: list[DataFrame]
    root: tuple


def _lot(seed: int, text: Column) -> Column:
    """60 bits of a hash as a number that sums don't overflow."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), 1, 15), 16, 10).cast("decimal(38,0)")


def _sums() -> list[Column]:
    """An order-free digest of rows: how many there are, and two sums of their hashes. Repeated rows count each."""
    text = F.to_json(F.struct("next_token", "numleaves", "below"))
    return [F.count("*").alias("rows"), F.sum(_lot(0, text)).alias("one"), F.sum(_lot(1, text)).alias("two")]


def fold(edge: DataFrame) -> DigestTree:
    """The digests of edge(prefix, depth, next_token, numleaves).

    A node's digest sums hashes of its edges, each with the digest of its child, so it needs no order and map-side partial sums do most of it: a node of very many children doesn't meet in one task.
    Every level is read once and meets the level below by the child's prefix; jobs are as many as levels, rows over all of them are the edges. A tree without edges has the root (0, 0, 0).
    Two different trees have equal roots with odds of about 2 to the minus 120. Edges above which nothing hangs (a tree cut off at the top) are levels like others, but no root leads to them.
    """
    rows = lineage.cut(edge.select("prefix", "depth", "next_token", "numleaves"))
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return DigestTree([], (0, 0, 0))
    levels: list[DataFrame] = []
    nodes = None
    empty = F.lit(None).cast("struct<rows:bigint,one:decimal(38,0),two:decimal(38,0)>").alias("below")
    for depth in range(deepest, -1, -1):
        here = rows.where(F.col("depth") == depth).select("prefix", "next_token", "numleaves")
        if nodes is None:
            level = here.select("*", empty)
        else:
            child = F.concat("prefix", F.array("next_token"))
            level = here.join(nodes, child == F.col("node"), "left").select(*here.columns, "below")
        level = lineage.cut(level)
        levels.append(level)
        nodes = level.groupBy(F.col("prefix").alias("node")).agg(*_sums()).select("node", F.struct("rows", "one", "two").alias("below"))
    top = nodes.where(F.size("node") == 0).select("below.*").first()
    return DigestTree(levels[::-1], tuple(top) if top else (0, 0, 0))


def difference(a: DigestTree, b: DigestTree) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges in which two trees differ, and what was looked at; None and None where the roots are equal.

    The first: prefix, depth, next_token, a and b (leaves below the edge in either tree, null where it isn't there). The second: level and nodes, how many nodes of each level were opened.
    Both trees have at most one edge of a prefix and token. A step opens the nodes whose digests differ, meets their edges by prefix and token, and goes on below those edges whose child digests differ.
    """
    if a.root == b.root:
        return None, None
    some = (a.levels or b.levels)[0]
    kind, token = some.schema["prefix"].dataType.simpleString(), some.schema["next_token"].dataType.simpleString()
    spark = some.sparkSession
    nothing = spark.createDataFrame([], f"prefix {kind}, next_token {token}, numleaves long, below struct<rows:bigint,one:decimal(38,0),two:decimal(38,0)>")
    open_ = spark.range(1).select(F.expr(f"cast(array() as {kind})").alias("prefix"))
    found, opened = [], []
    for depth in range(max(len(a.levels), len(b.levels))):
        sides = []
        for name, tree in (("a", a), ("b", b)):
            level = tree.levels[depth] if depth < len(tree.levels) else nothing
            sides.append(level.join(open_, "prefix", "left_semi").select("prefix", F.struct("next_token").alias("step"), F.col("numleaves").alias(name), F.col("below").alias(f"{name}_below")))
        met = lineage.cut(sides[0].join(sides[1], ["prefix", "step"], "full").withColumn("next_token", F.col("step.next_token")))
        opened.append(open_.select(F.lit(depth).cast("long").alias("level")).groupBy("level").agg(F.count("*").alias("nodes")))
        found.append(met.where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix", F.lit(depth).cast("long").alias("depth"), "next_token", "a", "b"))
        open_ = met.where(~F.col("a_below").eqNullSafe(F.col("b_below"))).select(F.concat("prefix", F.array("next_token")).alias("prefix"))
        if open_.isEmpty():
            break
    return _all(found), _all(opened)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
