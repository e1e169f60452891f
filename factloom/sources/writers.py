"""Writers: the stored index, fact files, logs, reports, training rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import tokens
from factloom.operators import trie


def build_index(sequences: DataFrame, path: str, switch: int = 6, config: dict | None = None) -> None:
    """Build and store the depth-cut index of sequences(tokens): edges by depth and sorted by key for skipping, suffixes, and one row of configuration.

    An index that is there is replaced. switch counts real tokens, without a root.
    """
    upper, lower = trie.depth_cut(sequences, switch)
    keyed = upper.withColumn("key_text", tokens.joined("prefix"))
    keyed.repartition("depth", F.expr("pmod(hash(key_text, next_token), 32)")).sortWithinPartitions("depth", "key_text").write.mode("overwrite").partitionBy("depth").parquet(f"{path}/edges")
    lower.withColumn("key_text", tokens.joined("key")).repartition("key_text", "suffix").sortWithinPartitions("key_text").write.mode("overwrite").parquet(f"{path}/suffixes")
    spark = sequences.sparkSession
    spark.createDataFrame([(switch, json.dumps(config or {}))], "switch int, config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


def index_config(spark: SparkSession, path: str) -> dict:
    row = spark.read.parquet(f"{path}/config").first()
    return {"switch": row["switch"], **json.loads(row["config"])}


def facts(lines: DataFrame, path: str, compression: str = "bzip2") -> None:
    lines.select("fact").write.option("compression", compression).text(path)


def run_log(header: dict, rows: DataFrame, path: str, order: str) -> None:
    """A JSON-lines log of one file: the run's metadata, then the rows by order. For logs of one run, which one task can write."""
    head = rows.sparkSession.createDataFrame([(0, json.dumps(header))], "part int, value string")
    lines = rows.select(F.lit(1).alias("part"), F.to_json(F.struct(*rows.columns)).alias("value"), F.col(order).alias("at"))
    head = head.withColumn("at", F.lit(None).cast(rows.schema[order].dataType))
    head.unionByName(lines).coalesce(1).sortWithinPartitions("part", "at").select("value").write.text(path)


def binary(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of bytes, such as an archive."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()


def log(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "errorifexists").json(path)


def report(tables: dict[str, DataFrame], path: str, force: bool = False) -> None:
    """One folder for each table, as Parquet and JSON; refuses to overwrite unless forced."""
    for name, df in tables.items():
        mode = "overwrite" if force else "errorifexists"
        df.write.mode(mode).parquet(f"{path}/{name}.parquet")
        df.coalesce(1).write.mode(mode).json(f"{path}/{name}.json")


def training_rows(rows: DataFrame, path: str) -> None:
    rows.write.parquet(path)


def disk_usage(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Bytes below each folder and file directly under path, largest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(((s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength()) for s in fs.listStatus(p)), key=lambda x: -x[1])
