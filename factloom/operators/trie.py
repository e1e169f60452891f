"""The prefix tree of token sequences as relations.

edge(prefix, depth, next_token, numleaves): numleaves counts the distinct maximal sequences that start with prefix and next_token.
A sequence that is a strict prefix of another is no leaf; repeats count once. Other counts have functions of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage, series


#: Sequences that share their first two tokens up to which one window sorts them, and how many larger groups there are at most.
HOT, HOT_GROUPS = 1_000_000, 10_000
#: Tokens that compact_edges numbers at once.
VALUES = 1 << 17


def maximal_leaves(sequences: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The distinct sequences that are no strict prefix of another. Empty sequences are none.

    In sorted order a sequence is a strict prefix of another exactly if it is one of its successor, so one window replaces
    a join with all prefixes. Sequences are windowed by their first two tokens (a sequence of one token goes to its own window, and
    is tested against the first tokens of the longer ones); groups too large for one task are sorted by ranges instead.
    """
    return _maximal(sequences.select(F.col(tokens).alias("tokens")), [])


def _maximal(sequences: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct rows (keys, tokens) whose tokens no other row of the same keys continues."""
    rows = sequences.where(F.size("tokens") > 0)
    first, second, size = F.element_at("tokens", 1), F.element_at("tokens", 2), F.size("tokens")
    longer = rows.where(size > 1).withColumns({"t1": first, "t2": second})
    group = [*keys, "t1", "t2"]
    sizes = longer.groupBy(*group).agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > HOT)
    if hot.isEmpty():
        kept = _windowed(longer.select(*group, "tokens").distinct(), group)
    else:
        least = max(HOT, -(-longer.count() // HOT_GROUPS))
        large = F.broadcast(sizes.where(F.col("n") > least).select(*group))  # HOT_GROUPS rows at most
        kept = _windowed(longer.join(large, group, "left_anti").select(*group, "tokens").distinct(), group).unionByName(_ranged(longer.join(large, group, "left_semi").select(*group, "tokens"), group))
    heads = longer.select(*keys, F.col("t1").alias("head")).distinct()
    single = rows.where(size == 1).select(*keys, "tokens", first.alias("head")).distinct().join(heads, [*keys, "head"], "left_anti")
    return kept.select(*keys, "tokens").unionByName(single.select(*keys, "tokens"))


def _windowed(distinct: DataFrame, group: list[str]) -> DataFrame:
    after = F.lead("tokens").over(Window.partitionBy(*group).orderBy("tokens"))
    return distinct.withColumn("after", after).where(F.col("after").isNull() | (F.slice("after", 1, F.size("tokens")) != F.col("tokens"))).drop("after")


def _ranged(rows: DataFrame, group: list[str]) -> DataFrame:
    """Likewise of rows that may repeat, in ranges of the sorted rows, whatever they share: only the first row of each range is needed beyond it."""
    local = lineage.cut(rows.repartitionByRange(*group, "tokens").withColumn("part", F.spark_partition_id()))  # ranges hold only as long as rows don't move
    distinct = local.distinct()
    starts = local.groupBy("part").agg(F.min(F.struct(*group, "tokens")).alias("start"))  # as many as there are ranges
    following = starts.select((F.dense_rank().over(Window.orderBy("part")) - 1).alias("place"), "part", "start")
    following = following.select("part", F.lead("start").over(Window.orderBy("place")).alias("start"))
    inside = F.lead(F.struct(*group, "tokens")).over(Window.partitionBy("part").orderBy(*group, "tokens"))
    seen = distinct.withColumn("inside", inside).join(F.broadcast(following), "part").withColumn("next", F.coalesce("inside", "start"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"next.{g}"))
    continued = F.col("next").isNotNull() & same & (F.slice("next.tokens", 1, F.size("tokens")) == F.col("tokens"))
    return seen.where(~F.coalesce(continued, F.lit(False))).select(*group, "tokens")


def _explode(leaves: DataFrame, depth: int | None, count: Column) -> DataFrame:
    last = F.size("tokens") - 1 if depth is None else F.least(F.size("tokens") - 1, F.lit(depth - 1))
    rows = leaves.where(F.size("tokens") > 0).select("tokens", F.explode(F.sequence(F.lit(0), last)).alias("depth"))
    keyed = rows.select(F.slice("tokens", F.lit(1), F.col("depth")).alias("prefix"), "depth", F.element_at("tokens", F.col("depth") + 1).alias("next_token"))
    return keyed.groupBy("prefix", "depth", "next_token").agg(count.alias("numleaves"))


def edges(sequences: DataFrame, depth: int | None = None, leaves: bool = False) -> DataFrame:
    """The edge relation of sequences(tokens); down to depth tokens if given. leaves: the sequences are distinct and maximal already."""
    return _explode(sequences.select("tokens") if leaves else maximal_leaves(sequences), depth, F.count("*"))


def compact_edges(leaves: DataFrame) -> DataFrame:
    """Edges whose nodes are numbers instead of prefixes: parent, child (each 128 bits as two longs), depth, next_token, numleaves. The root is (0, 0).

    A prefix's number is the sum of hashes of its tokens at their places, so all prefixes of a sequence cost its length, not the square of it; edges() with a depth suits
    short prefixes, this one whole documents. leaves(tokens) are distinct and maximal. Sums come from Arrow batches, as SQL's would overflow.
    """
    kind = leaves.schema["tokens"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            lists = b.column(0)
            values, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            opened = [np.zeros(2, np.uint64), np.zeros(2, np.uint64)]  # for each hash, the sum so far and the sum where the current sequence began
            for at in range(0, len(values), VALUES):
                some = values.slice(at, VALUES)
                place = np.arange(at, at + len(some))
                start = offsets[np.searchsorted(offsets, place, side="right") - 1]  # of the sequence, in values
                depth = place - start
                out = {"depth": pa.array(depth.astype(np.int32)), "next_token": some}
                raw = some.to_pandas().to_numpy()
                for k, key in enumerate(("0123456789abcdef", "fedcba9876543210")):
                    x = pd.util.hash_array(raw, hash_key=key, categorize=False) + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    total = opened[k][0] + np.concatenate([np.zeros(1, np.uint64), np.cumsum(pd.util.hash_array(x + np.uint64(k)), dtype=np.uint64)])
                    first = np.where(start < at, opened[k][1], total[np.maximum(start - at, 0)])
                    out[f"p{k}"] = pa.array((total[:-1] - first).view(np.int64))
                    out[f"c{k}"] = pa.array((total[1:] - first).view(np.int64))
                    opened[k] = np.array([total[-1], first[-1]])
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    rows = leaves.select("tokens").mapInArrow(run, f"depth int, next_token {kind}, p0 long, c0 long, p1 long, c1 long")
    sums = rows.groupBy("depth", "p0", "p1", "c0", "c1", "next_token").agg(F.count("*").alias("numleaves"))
    return sums.select(F.struct("p0", "p1").alias("parent"), F.struct("c0", "c1").alias("child"), "depth", "next_token", "numleaves")


def edges_multiplicity(sequences: DataFrame, depth: int | None = None) -> DataFrame:
    """Edges in which every inserted sequence counts, repeats and strict prefixes too."""
    return _explode(sequences.select("tokens"), depth, F.count("*"))


def marked_edges(sequences: DataFrame, depth: int | None = None) -> DataFrame:
    """Edges with end marks: prefix, depth, next_token, numfacts and ends, so that a fact which another continues keeps its count, and a node can be both an end and inner.

    numfacts counts the distinct sequences that start with prefix and next_token, ends tells whether one of them ends there. Empty sequences are none. Down to depth tokens if given.
    """
    last = F.size("tokens") - 1 if depth is None else F.least(F.size("tokens") - 1, F.lit(depth - 1))
    rows = sequences.select("tokens").where(F.size("tokens") > 0).distinct().select("tokens", F.explode(F.sequence(F.lit(0), last)).alias("depth"))
    return marked_steps(rows)


def marked_steps(rows: DataFrame) -> DataFrame:
    """Edges with end marks of rows(tokens, depth): of each sequence the steps at those depths."""
    keyed = rows.select(F.slice("tokens", F.lit(1), F.col("depth")).alias("prefix"), "depth", F.element_at("tokens", F.col("depth") + 1).alias("next_token"), (F.size("tokens") == F.col("depth") + 1).alias("end"))
    return keyed.groupBy("prefix", "depth", "next_token").agg(F.count("*").alias("numfacts"), F.bool_or("end").alias("ends"))


def raw_visits(sequences: DataFrame) -> DataFrame:
    """prefix, depth and visits: how many insertions continue past each node, the root's empty prefix included. Nodes where all insertions end have 0."""
    some = sequences.where(F.size("tokens") > 0)
    rows = some.select("tokens", F.explode(F.sequence(F.lit(0), F.size("tokens"))).alias("depth"))
    passes = (F.col("depth") < F.size("tokens")).cast("long")
    return rows.select(F.slice("tokens", F.lit(1), F.col("depth")).alias("prefix"), "depth", passes.alias("pass")).groupBy("prefix", "depth").agg(F.sum("pass").alias("visits"))


def level_sizes(visits: DataFrame, node_bytes: int = 64, edge_bytes: int = 16) -> DataFrame:
    """Of raw_visits: by depth, estimated bytes of its nodes' subtrees (own and all below): nodes, min, max, mean and the quantiles 0.75, 0.9, 0.99."""
    below = visits.select("prefix", "depth", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level"))
    trees = below.groupBy("level", F.slice("prefix", F.lit(1), F.col("level")).alias("root")).agg((F.count("*") * node_bytes + (F.count("*") - 1) * edge_bytes).alias("bytes"))
    out = series.summary(trees, "bytes", ["level"], (0.75, 0.9, 0.99))
    return out.select("level", F.col("num").alias("nodes"), "min", "max", F.col("avg").alias("mean"), "q75", "q90", "q99")


def edges_at(probes: DataFrame, leaves: DataFrame, head: int = 1) -> DataFrame:
    """Only the edges below probes(probe), of leaves(tokens), distinct and maximal.

    Leaves are cut down to those that begin with the first head tokens of a probe, and only as deep as its probes go; a probe of fewer tokens than head must be the root.
    """
    p = probes.select("probe").distinct()
    first = lambda c: F.slice(c, 1, head)
    heads = p.where(F.size("probe") >= head).groupBy(first("probe").alias("head")).agg(F.max(F.size("probe")).alias("most"))
    near = leaves.join(heads, first("tokens") == F.col("head")).where(F.size("tokens") > head)
    deep = near.select("tokens", F.explode(F.sequence(F.lit(head), F.least(F.size("tokens") - 1, "most"))).alias("depth"))
    deep = deep.select(F.slice("tokens", F.lit(1), F.col("depth")).alias("prefix"), "depth", F.element_at("tokens", F.col("depth") + 1).alias("next_token"))
    deep = deep.join(p, F.col("prefix") == F.col("probe"), "left_semi").groupBy("prefix", "depth", "next_token").agg(F.count("*").alias("numleaves"))
    root = leaves.groupBy(F.element_at("tokens", 1).alias("next_token")).agg(F.count("*").alias("numleaves"))
    root = root.select(F.slice(F.array("next_token"), 1, 0).alias("prefix"), F.lit(0).alias("depth"), "next_token", "numleaves").join(p, F.col("prefix") == F.col("probe"), "left_semi")
    return deep.unionByName(root)


def nodes(edge: DataFrame) -> DataFrame:
    """key, depth, numleaves and next, the map from tokens to leaves."""
    kv = F.sort_array(F.collect_list(F.struct("next_token", "numleaves")))
    return edge.groupBy(F.col("prefix").alias("key"), "depth").agg(F.sum("numleaves").alias("numleaves"), F.map_from_entries(kv).alias("next"))


def depth_cut(sequences: DataFrame, switch: int, leaves: bool = False) -> tuple[DataFrame, DataFrame]:
    """The persisted form: edges below prefixes shorter than switch tokens, and suffixes(key, suffix) of what leaves hold below keys of switch tokens.

    leaves: the sequences are distinct and maximal already.

    Edges stay rows, one for each child, so that no row grows with a node's children; nodes() makes maps of them.

    With a root token in front of every key, as the original counts, its switch parameter is one more than ours.
    """
    whole = sequences.select("tokens") if leaves else maximal_leaves(sequences)
    upper = edges(whole, depth=switch, leaves=True)
    lower = whole.where(F.size("tokens") > switch).select(F.slice("tokens", 1, switch).alias("key"), F.expr(f"slice(tokens, {switch + 1}, size(tokens))").alias("suffix"))
    return upper, lower


def rooted(suffixes: DataFrame) -> DataFrame:
    """Sequences again: each suffix under its key."""
    return suffixes.select(F.concat("key", "suffix").alias("tokens"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves of the union of two trees given as sequences(tokens)."""
    return maximal_leaves(a.select("tokens").unionByName(b.select("tokens")))


def merge_edges(*trees: DataFrame) -> DataFrame:
    """Edge relations added up child by child, as for trees of batches that share no leaf; a leaf of several counts several times."""
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out.groupBy("prefix", "depth", "next_token").agg(F.sum("numleaves").alias("numleaves"))


def batch_summed(sequences: DataFrame, batch: str = "batch") -> DataFrame:
    """Edges of trees built for each batch alone, added up."""
    return _explode(_maximal(sequences.select(batch, "tokens"), [batch]).select("tokens"), None, F.count("*"))


def recount(edge: DataFrame) -> DataFrame:
    """For each edge: numleaves as stored, and as its child's edges add up to (1 for a leaf); wrong where they differ."""
    below = edge.groupBy(F.col("prefix").alias("below")).agg(F.sum("numleaves").alias("s"))
    child = F.concat("prefix", F.array("next_token"))
    counted = F.coalesce(F.col("s"), F.lit(1).cast("long"))
    return edge.join(below, child == F.col("below"), "left").select("prefix", "depth", "next_token", "numleaves", counted.alias("counted"), (F.col("numleaves") != counted).alias("wrong"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def size(edge: DataFrame) -> int:
    """Leaves below the root."""
    return edge.where("depth = 0").agg(F.coalesce(F.sum("numleaves"), F.lit(0))).first()[0]


def dump(edge: DataFrame, spacer: str = "\t") -> str:
    """The tree as indented text, one line for each edge: token and leaves. For small trees: it is made on the driver."""
    rows = sorted((tuple(r["prefix"]), r["next_token"], r["numleaves"]) for r in edge.collect())
    below: dict[tuple, list] = {}
    for prefix, token, n in rows:
        below.setdefault(prefix, []).append((token, n))
    out, stack = [], [((), *x) for x in reversed(below.get((), []))]
    while stack:
        prefix, token, n = stack.pop()
        out.append(f"{spacer * len(prefix)}{token} {n}")
        stack += [((*prefix, token), *x) for x in reversed(below.get((*prefix, token), []))]
    return "\n".join(out)


def prefix_leaves(edge: DataFrame, probes: DataFrame) -> DataFrame:
    """probe and numleaves, the leaves below each of probes(probe); 0 where there is none."""
    sums = edge.groupBy(F.col("prefix").alias("p")).agg(F.sum("numleaves").alias("numleaves"))
    return probes.join(sums, F.col("probe") == F.col("p"), "left").select("probe", F.coalesce("numleaves", F.lit(0).cast("long")).alias("numleaves"))
