"""Look-up in the fact trie: next tokens with a status, subtraction of used facts, the persisted form, and a small cache for point reads."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lineage, trie

#: Status of a look-up. EXHAUSTED: the continuations are there, but used up.
OK, COMPLETE, NOT_FOUND, EMPTY, EXHAUSTED = "OK", "COMPLETE", "NOT_FOUND", "EMPTY", "EXHAUSTED"


def _no_tokens(token: str) -> Column:
    return F.expr(f"map_from_arrays(cast(array() as array<{token}>), cast(array() as array<bigint>))")


def next_tokens(probes: DataFrame, leaves: DataFrame, edge: DataFrame | None = None) -> DataFrame:
    """For each of probes(probe): probe, status and next, the map from tokens to leaves (empty unless OK).

    leaves(tokens) are distinct and maximal. A probe that is a leaf, or goes past one, is COMPLETE; one that leaves the tree is NOT_FOUND; without leaves all are EMPTY.
    """
    p = lineage.cut(probes.select("probe").distinct())  # read five times below
    edge = trie.edges_at(p, leaves) if edge is None else edge.join(p, F.col("prefix") == F.col("probe"), "left_semi")
    node = trie.nodes(edge).select("key", "next")
    some = leaves.limit(1).select(F.lit(True).alias("any"))
    # prefixes of a probe, itself included, against the leaves: the one equi-join that finds leaves which a probe reaches or passes
    reach = p.select("probe", F.explode(F.sequence(F.lit(1), F.size("probe"))).alias("k")).where(F.size("probe") > 0).select("probe", F.slice("probe", F.lit(1), F.col("k")).alias("head"))
    done = reach.join(leaves.select(F.col("tokens").alias("head")), "head", "left_semi").select("probe").distinct().withColumn("done", F.lit(True))
    found = p.join(node, F.col("probe") == F.col("key"), "left").join(done, "probe", "left").join(F.broadcast(some), F.lit(True), "left")
    status = F.when(F.col("any").isNull(), EMPTY).when(F.col("key").isNotNull(), OK).when(F.col("done"), COMPLETE).otherwise(NOT_FOUND)
    token = edge.schema["next_token"].dataType.simpleString()
    return found.select("probe", status.alias("status"), F.when(status == OK, F.col("next")).otherwise(_no_tokens(token)).alias("next"))


def marked_next_tokens(probes: DataFrame, sequences: DataFrame) -> DataFrame:
    """For each of probes(probe): is_fact (the probe is itself one of sequences(tokens)), numfacts (distinct facts that begin with it, itself included) and next, the map from tokens to facts.

    Facts count whether or not others continue them, so a probe can be a fact and lead on. A probe that leads nowhere has an empty map; the empty probe is no fact, and all begin with it. Null probes are none.
    Facts are cut only at lengths that probes have, and meet the probes before they are counted; partial counts keep a probe that many facts share, such as the empty one, from meeting in one task.
    """
    p = lineage.cut(probes.where("probe is not null").select("probe").distinct())  # read twice below
    facts = sequences.select("tokens").where(F.size("tokens") > 0).distinct()
    lengths = F.broadcast(p.agg(F.sort_array(F.collect_set(F.size("probe"))).alias("lengths")))  # one row; no longer than the longest probe
    cuts = facts.join(lengths).select("tokens", F.explode(F.filter("lengths", lambda n: n <= F.size("tokens"))).alias("depth"))
    rows = cuts.select(F.slice("tokens", F.lit(1), F.col("depth")).alias("probe"), F.get("tokens", F.col("depth")).alias("next_token"), (F.size("tokens") == F.col("depth")).alias("is_fact"))
    counts = rows.join(p, "probe", "left_semi").groupBy("probe", "is_fact", "next_token").agg(F.count("*").alias("n"))
    step = F.when(~F.col("is_fact"), F.struct("next_token", F.col("n").alias("numleaves")))
    maps = counts.groupBy("probe").agg(F.bool_or("is_fact").alias("is_fact"), F.sum("n").alias("numfacts"), F.map_from_entries(F.sort_array(F.collect_list(step))).alias("next"))
    none = _no_tokens(sequences.schema["tokens"].dataType.elementType.simpleString())
    return p.join(maps, "probe", "left").select("probe", F.coalesce("is_fact", F.lit(False)).alias("is_fact"), F.coalesce("numfacts", F.lit(0).cast("long")).alias("numfacts"), F.coalesce("next", none).alias("next"))


def subtract(a: Column | str, b: Column | str) -> Column:
    """Map a less map b, token by token; tokens with nothing left are gone. A null b takes nothing away."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    left = F.map_zip_with(a, F.coalesce(b, F.map_filter(a, lambda k, v: F.lit(False))), lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    return F.map_filter(left, lambda k, v: v > 0)


def merge_maps(a: Column | str, b: Column | str) -> Column:
    """Maps of next tokens added up."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def subtract_used(possible: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """possible(keys, next_token, numleaves) less used likewise, rows with something left."""
    u = used.groupBy(*keys, "next_token").agg(F.sum("numleaves").alias("used"))
    left = F.col("numleaves") - F.coalesce("used", F.lit(0))
    return possible.join(u, [*keys, "next_token"], "left").select(*keys, "next_token", left.alias("numleaves")).where("numleaves > 0")


def persisted_next_tokens(probes: DataFrame, edge: DataFrame, suffixes: DataFrame, switch: int) -> DataFrame:
    """Look-up in the depth-cut form: probe and next. Probes shorter than switch read edges, others the suffixes of their key; not found is an empty map.

    Rows of an edge that several batches wrote are added up. Suffixes are expanded and counted only as deep as the probes of their key go, then meet them by equality,
    so that many probes of a hot key don't multiply with its suffixes.
    """
    p = probes.select("probe").distinct()
    short = p.where(F.size("probe") < switch).join(edge.select("prefix", "next_token", "numleaves"), F.col("probe") == F.col("prefix"))
    short = short.groupBy("probe", "next_token").agg(F.sum("numleaves").alias("numleaves"))
    deep = trie.edges_at(p.where(F.size("probe") >= switch), trie.rooted(suffixes), switch).select(F.col("prefix").alias("probe"), "next_token", "numleaves")
    pairs = F.sort_array(F.collect_list(F.struct("next_token", "numleaves")))
    maps = short.unionByName(deep).groupBy("probe").agg(F.map_from_entries(pairs).alias("next"))
    return p.join(maps, "probe", "left").select("probe", F.coalesce("next", _no_tokens(edge.schema["next_token"].dataType.simpleString())).alias("next"))


class PointReader:
    """next(prefix) of single prefixes, from the edge relation, with the last few answers remembered on the driver."""

    def __init__(self, edge: DataFrame, remember: int = 1024):
        self.edge, self.remember, self.answers = edge, remember, OrderedDict()

    def next(self, prefix: list) -> dict:
        key = ".".join(map(str, prefix))
        if key in self.answers:
            self.answers.move_to_end(key)
            return self.answers[key]
        at = F.array(*[F.lit(t) for t in prefix]) if prefix else F.expr("slice(prefix, 1, 0)")
        found = {r["next_token"]: r["numleaves"] for r in self.edge.where((F.col("depth") == len(prefix)) & (F.col("prefix") == at)).select("next_token", "numleaves").collect()}
        self.answers[key] = found
        if len(self.answers) > self.remember:
            self.answers.popitem(last=False)
        return found
