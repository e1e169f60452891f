"""A stored index in buckets: look-ups meet it bucket by bucket, so that only probes move, never the index.

Rows are bucketed by their place: the key as text, and a lot of it. A key of more than HOT rows is dealt out over as many lots as it needs, so that no bucket grows with one key;
the places of such keys are a table of their own, one row for each, and a probe of one goes to all its lots.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import lineage, lookup, trie

#: Rows of a key that one lot holds, and over how many tasks a key's rows are dealt while their lots are looked up.
HOT, SALTS = 100_000, 64
_HEADS = "part string, key_text string, lots int"


@dataclass(frozen=True)
class BucketedIndex:
    """edges(place, prefix, next_token, numleaves), suffixes(place, key, suffix), heads(part, key_text, lots) and the depth at which the tree is cut."""

    edges: DataFrame
    suffixes: DataFrame
    heads: DataFrame
    switch: int


def _text(tokens: Column | str) -> Column:
    """A key as text; different keys have different texts, whatever their tokens hold."""
    return F.to_json(tokens)


def _place(key_text: Column, lot: Column) -> Column:
    return F.concat_ws("#", lot.cast("string"), key_text)


def _heads(rows: DataFrame, part: str, key: str, hot: int) -> DataFrame:
    """part, key_text and lots of the keys of more than hot rows."""
    lots = F.ceil(F.count("*") / hot).cast("int")
    return rows.groupBy(_text(key).alias("key_text")).agg(lots.alias("lots")).where("lots > 1").select(F.lit(part).alias("part"), "key_text", "lots")


def _dealt(rows: DataFrame, heads: DataFrame, key: str, by: str) -> DataFrame:
    """rows with their place. Heads stand once for each salt, so that where they are too many to broadcast, a hot key's rows still meet theirs in many tasks."""
    salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = rows.withColumns({"key_text": _text(key), "salt": F.pmod(F.hash(by), F.lit(SALTS))})
    place = _place(F.col("key_text"), F.coalesce(F.pmod(F.xxhash64(by), "lots"), F.lit(0)))
    return keyed.join(salted, ["key_text", "salt"], "left").select(place.alias("place"), *rows.columns)


def build(sequences: DataFrame, path: str, switch: int = 6, buckets: int = 200, hot: int = HOT) -> None:
    """Build the depth-cut index of sequences(tokens) and store it at path, a folder that driver and executors share. An index that is there is replaced.

    With at least as many buckets as spark.sql.shuffle.partitions, joins keep the index where it is.
    """
    spark = sequences.sparkSession
    upper, lower = trie.depth_cut(lineage.cut(trie.maximal_leaves(sequences)), switch, leaves=True)  # read by both parts and their heads
    upper = lineage.cut(upper.select("prefix", "next_token", "numleaves"))
    _heads(upper, "edges", "prefix", hot).unionByName(_heads(lower, "suffixes", "key", hot)).write.mode("overwrite").parquet(f"{path}/heads")
    heads = lambda part: spark.read.schema(_HEADS).parquet(f"{path}/heads").where(F.col("part") == part).drop("part")
    edges, suffixes = _dealt(upper, heads("edges"), "prefix", "next_token"), _dealt(lower, heads("suffixes"), "key", "suffix")
    for name, rows in (("edges", edges), ("suffixes", suffixes)):
        table = _name(path, name)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        out = rows.repartition(buckets, "place").sortWithinPartitions("place").write.mode("overwrite").bucketBy(buckets, "place").sortBy("place")
        out.format("parquet").option("path", f"{path}/{name}").saveAsTable(table)
    kind = lower.schema["suffix"].dataType.simpleString()
    spark.createDataFrame([(switch, buckets, kind)], "switch int, buckets int, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


def _name(path: str, part: str) -> str:
    return f"factloom_{part}_{hashlib.md5(path.encode()).hexdigest()}"


def attach(spark: SparkSession, path: str) -> BucketedIndex:
    """The index at path. Sessions whose catalogue doesn't know its tables are told of them."""
    config = spark.read.parquet(f"{path}/config").first()
    kind, element = config["kind"], config["kind"].removeprefix("array<").removesuffix(">")
    columns = {"edges": f"prefix {kind}, next_token {element}, numleaves bigint", "suffixes": f"key {kind}, suffix {kind}"}
    for part, own in columns.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path, part)} (place string, {own}) USING parquet CLUSTERED BY (place) SORTED BY (place) INTO {config['buckets']} BUCKETS LOCATION '{path}/{part}'")
    return BucketedIndex(spark.table(_name(path, "edges")), spark.table(_name(path, "suffixes")), spark.read.schema(_HEADS).parquet(f"{path}/heads"), config["switch"])


def detach(spark: SparkSession, path: str) -> None:
    """Forget the tables of path; its files stay."""
    for part in ("edges", "suffixes"):
        spark.sql(f"DROP TABLE IF EXISTS {_name(path, part)}")


def _at_places(keys: DataFrame, index: BucketedIndex, part: str) -> DataFrame:
    """keys(key_text, ...) once for each place of their key."""
    lots = index.heads.where(F.col("part") == part).drop("part")
    rows = keys.join(lots, "key_text", "left").withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1)))
    return rows.withColumn("at", _place(F.col("key_text"), F.col("lot"))).drop("key_text", "lots", "lot")


def next_tokens(probes: DataFrame, index: BucketedIndex) -> DataFrame:
    """probe and next of the distinct probes(probe), as lookup.persisted_next_tokens(): not found is an empty map, a null probe too.

    Below switch tokens a probe meets the edges of its place. Longer ones meet the suffixes of their key, once for each key: those are expanded as deep as the key's probes go,
    and only what was expanded is counted and meets the probes by equality.
    """
    p = probes.select("probe").distinct()
    low = p.where(F.size("probe") < index.switch).withColumn("key_text", _text("probe"))
    short = _at_places(low, index, "edges").join(index.edges.select("place", "next_token", "numleaves"), F.col("at") == F.col("place")).select("probe", "next_token", "numleaves")
    high = p.where(F.size("probe") >= index.switch)
    keys = high.groupBy(_text(F.slice("probe", 1, index.switch)).alias("key_text")).agg(F.max(F.size("probe")).alias("most"))
    near = _at_places(keys, index, "suffixes").join(index.suffixes, F.col("at") == F.col("place")).select(F.concat("key", "suffix").alias("tokens"), "most")
    deep = near.select("tokens", F.explode(F.sequence(F.lit(index.switch), F.least(F.size("tokens") - 1, "most"))).alias("depth"))
    steps = deep.select(F.slice("tokens", F.lit(1), F.col("depth")).alias("probe"), F.element_at("tokens", F.col("depth") + 1).alias("next_token"))
    deep = steps.groupBy("probe", "next_token").agg(F.count("*").alias("numleaves")).join(high, "probe", "left_semi")
    pairs = F.sort_array(F.collect_list(F.struct("next_token", "numleaves")))
    maps = short.unionByName(deep).groupBy("probe").agg(F.map_from_entries(pairs).alias("next"))
    return p.join(maps, "probe", "left").select("probe", F.coalesce("next", lookup._no_tokens(index.edges.schema["next_token"].dataType.simpleString())).alias("next"))
