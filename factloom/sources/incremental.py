"""A stored index that takes in batches: only the partitions that a batch changes are written again.

Folders below the index: leaves by bucket, edges by depth and bucket (prefixes shorter than `switch`), config. A bucket is the hash of the first `head` tokens, so a fact and all that
continue it share one; what is shorter lies in bucket -1. A batch is met with the leaves of its own buckets only. Its effect is a table of signed counts: a fact that is new adds one along its
path, an old one that a new one continues takes its own away again, repeats and facts that an old one already continues add nothing.

A batch is staged first, with a manifest written last; then partitions are replaced. Replacing can be repeated, so a run that is lost on the way is finished by the next one,
and a batch that never came as far as its manifest leaves no trace.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import tokens as T
from factloom.operators import lineage, trie

#: The bucket of what has fewer tokens than decide one.
SHORT = -1


def create(spark: SparkSession, path: str, switch: int = 6, head: int = 2, buckets: int = 64, token: str = "string") -> None:
    """An empty index. head: tokens that decide the bucket, switch at most; take more where facts begin alike."""
    if not 1 <= head <= switch:
        raise ValueError("head must lie between 1 and switch")
    told = {"switch": switch, "head": head, "buckets": buckets, "token": token}
    _fs(spark, path)[0].mkdirs(_fs(spark, path)[1])
    spark.createDataFrame([(json.dumps(told),)], "config string").coalesce(1).write.parquet(f"{path}/config")


def config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema("config string").parquet(f"{path}/config").first()["config"])


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """tokens and bucket of all facts of the index."""
    return _table(spark, f"{path}/leaves", f"tokens array<{config(spark, path)['token']}>, bucket int")


def edges(spark: SparkSession, path: str) -> DataFrame:
    """prefix, next_token, numleaves, key_text, depth and bucket, of prefixes shorter than switch."""
    token = config(spark, path)["token"]
    return _table(spark, f"{path}/edges", f"prefix array<{token}>, next_token {token}, numleaves long, key_text string, depth int, bucket int")


def suffixes(spark: SparkSession, path: str) -> DataFrame:
    """key and suffix of the facts longer than switch, as look-ups in the persisted form take them."""
    switch = config(spark, path)["switch"]
    return leaves(spark, path).where(F.size("tokens") > switch).select(F.slice("tokens", 1, switch).alias("key"), F.expr(f"slice(tokens, {switch + 1}, size(tokens))").alias("suffix"))


def append(sequences: DataFrame, path: str) -> dict:
    """Take the sequences(tokens) of a batch into the index. Returns what was written again: facts added and removed, partitions of edges and buckets of leaves.

    The index afterwards is that of all batches together: facts are the distinct sequences that no other continues. Empty and null sequences are none.
    """
    spark = sequences.sparkSession
    recover(spark, path)
    c = config(spark, path)
    switch, head = c["switch"], c["head"]
    bucket = lambda tokens: F.when(F.size(tokens) < head, SHORT).otherwise(F.pmod(F.xxhash64(F.slice(tokens, 1, head)), F.lit(c["buckets"]))).cast("int")
    old_edges, old_leaves = edges(spark, path), leaves(spark, path)
    new = lineage.cut(trie.maximal_leaves(sequences).withColumn("bucket", bucket(F.col("tokens"))))
    # short facts that an old one of any bucket continues; its first tokens are an inner node
    known = old_edges.where(F.col("depth").between(1, head - 1)).select(F.col("prefix").alias("tokens")).distinct()
    short = new.where(F.col("bucket") == SHORT).join(known, "tokens", "left_anti")
    new = new.where(F.col("bucket") != SHORT).unionByName(short)
    met = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # buckets + 1 at most
    old = old_leaves.where(F.col("bucket").isin(*met, SHORT))
    merged = trie.maximal_leaves(old.select("tokens").unionByName(new.select("tokens")))
    both = old.select("tokens", F.lit(-1).alias("sign")).unionByName(merged.select("tokens", F.lit(1).alias("sign")))
    changes = lineage.cut(both.groupBy("tokens").agg(F.sum("sign").cast("long").alias("sign")).where("sign <> 0").withColumn("bucket", bucket(F.col("tokens"))))
    steps = changes.select("tokens", "sign", F.explode(F.sequence(F.lit(0), F.least(F.size("tokens"), F.lit(switch)) - 1)).alias("depth"))
    steps = steps.select(F.slice("tokens", F.lit(1), F.col("depth")).alias("prefix"), F.element_at("tokens", F.col("depth") + 1).alias("next_token"), "depth", "sign")
    delta = lineage.cut(steps.groupBy("prefix", "next_token", "depth").agg(F.sum("sign").alias("numleaves")).where("numleaves <> 0").withColumn("bucket", bucket(F.col("prefix"))))
    parts = [(r["depth"], r["bucket"]) for r in delta.select("depth", "bucket").distinct().collect()]  # switch * (buckets + 1) at most
    homes = [r["bucket"] for r in changes.select("bucket").distinct().collect()]
    counted = _among(old_edges, parts).select("prefix", "next_token", "depth", "bucket", "numleaves").unionByName(delta.select("prefix", "next_token", "depth", "bucket", "numleaves"))
    counted = counted.groupBy("prefix", "next_token", "depth", "bucket").agg(F.sum("numleaves").alias("numleaves")).where("numleaves > 0").withColumn("key_text", T.joined("prefix"))
    stay = old_leaves.where(F.col("bucket").isin(*homes)).join(changes.where("sign < 0").select("tokens"), "tokens", "left_anti") if homes else old_leaves.limit(0)
    rows = stay.select("tokens", "bucket").unionByName(changes.where("sign > 0").select("tokens", "bucket"))
    tell = changes.agg(F.sum(F.when(F.col("sign") > 0, 1)).alias("added"), F.sum(F.when(F.col("sign") < 0, 1)).alias("removed")).first()
    told = {"added": tell["added"] or 0, "removed": tell["removed"] or 0, "edges": sorted(parts), "leaves": sorted(homes)}
    if parts:
        _sorted(counted, "depth", "bucket", "key_text").write.partitionBy("depth", "bucket").parquet(f"{path}/pending/edges")
        _sorted(rows, "bucket", "tokens").write.partitionBy("bucket").parquet(f"{path}/pending/leaves")
        spark.createDataFrame([(json.dumps(told),)], "manifest string").coalesce(1).write.parquet(f"{path}/pending/manifest")
        recover(spark, path)
    return told


def recover(spark: SparkSession, path: str) -> None:
    """Finish a batch that was staged but not taken in, and forget one that wasn't staged whole."""
    fs, root = _fs(spark, path)
    here = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pending{name}")
    if fs.exists(here("/manifest/_SUCCESS")):
        told = json.loads(spark.read.schema("manifest string").parquet(f"{path}/pending/manifest").first()["manifest"])
        token = config(spark, path)["token"]
        kept = spark.read.schema(f"tokens array<{token}>, bucket int").parquet(f"{path}/pending/leaves")
        rows = spark.read.schema(f"prefix array<{token}>, next_token {token}, numleaves long, key_text string, depth int, bucket int").parquet(f"{path}/pending/edges")
        _replace(rows, f"{path}/edges", "depth", "bucket")
        _replace(kept, f"{path}/leaves", "bucket")
        full = {r["bucket"] for r in kept.select("bucket").distinct().collect()}
        for b in set(told["leaves"]) - full:  # all its facts were continued by others
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/leaves/bucket={b}")
            fs.delete(gone, True)
    fs.delete(here(""), True)


def _fs(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fs, p = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def _among(edge: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """Edges of some partitions; a filter by partition columns only, so that other files aren't opened."""
    where: Column = F.lit(False)
    for depth in sorted({d for d, _ in parts}):
        where = where | ((F.col("depth") == depth) & F.col("bucket").isin(*[b for d, b in parts if d == depth]))
    return edge.where(where)


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of one partition of the index from as many tasks as its size asks for, each sorted."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
