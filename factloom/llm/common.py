"""What the corpus operators share: scratch tables, Arrow mapping, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.lineage import shared_folder

#: Rows of one Arrow batch. Texts may be long, so a batch stays far below the 10,000 rows of the default.
BATCH_ROWS = 1000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # for release()
    for made in _tracked:
        made.append(out)
    return out


_tracked: list[list[DataFrame]] = []


@contextmanager
def tracked() -> Iterator[list[DataFrame]]:
    """The tables that materialize() writes meanwhile, for release() when nothing reads them any more."""
    _tracked.append(made := [])
    try:
        yield made
    finally:
        _tracked.remove(made)


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of columns has, in either case."""
    taken, name = {c.lower() for c in columns}, f"__{name}"
    while name in taken:
        name += "_"
    return name


def release(*tables: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete tables of materialize(), or folders beside them, that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_scratch", None)
        if path and urlparse(path).path.count("/factloom/"):
            spark = spark or t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with batches of BATCH_ROWS rows at most, so that a worker's memory doesn't follow the rows of a partition."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(sliced, schema)


def by_rows(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Map each batch to a dict of columns in the order of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = rows(b)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))

    return map_arrow(df, run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """The smallest node reachable from each node of edges(a, b): rows (node, component), one for each node that has an edge to another.

    Alternating large and small stars: every round hangs all larger neighbours of a node on its smallest neighbour.
    A node's neighbours never meet in one list; only their minimum does, so partial aggregation bounds hubs,
    and the joins back are plain equi-joins whose skew the adaptive planner splits.
    Null nodes and loops are ignored. The edge table is written after each round, the one before it deleted.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("a", "b")
        near = both.where("b < a") if small else both
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = near.where("b < a" if small else "b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def stamp(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first())

    e = materialize(edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while (now := stamp(e)) != before:
        before = now
        following = materialize(star(star(e, False), True), name)
        release(e)
        e = following
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b"))).distinct()


def labelled(linked: DataFrame, classes: DataFrame) -> DataFrame:
    """node, component and component_id, the smallest doc of the component's classes(node, doc), for components() of nodes."""
    least = linked.join(classes.select("node", "doc"), "node").groupBy("component").agg(F.min("doc").alias("component_id"))
    return linked.join(least, "component").select("node", "component", "component_id")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows that share their first keys columns, of batches sorted by these."""
    key, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = np.flatnonzero(change).tolist()
        for s, e in zip([0, *edges], [*edges, b.num_rows], strict=True):
            if (now := tuple(c[s] for c in columns)) != key:
                if parts:
                    yield pa.Table.from_batches(parts)
                key, parts = now, []
            parts.append(b.slice(s, e - s))
    if parts:
        yield pa.Table.from_batches(parts)
