"""Quantiles of stored, mergeable sketches: one small row for each group and batch, so that a new batch doesn't read the old ones again.

The sketches are Spark's own KLL aggregates. series.ranked_quantiles() gives exact quantiles at the price of a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size parameter of a sketch: some 3 K values are kept, however many came.
K = 400


def rank_error(k: int = K) -> float:
    """How far the rank of a quantile may be off, as a share of all values: the published bound of KLL at 99 % confidence. Groups of k values or fewer are exact."""
    return 2.296 / k**0.9723


def sketch(values: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """keys and sketch of the values of each group that are neither null nor NaN; groups without such values have no row. Null keys are groups of their own."""
    number = F.col(value).cast("double")
    return values.where(number.isNotNull() & ~F.isnan(number)).groupBy(*keys).agg(F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """keys and sketch: the sketches of each group as one, such as those of several batches."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def told(sketches: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.75, 0.9, 0.99)) -> DataFrame:
    """keys, num, min, max (all exact) and quantiles (q75 and so on, values that came, within rank_error) of each sketch."""
    at: dict[str, Column] = {"min": _quantile(0.0), "max": _quantile(1.0)} | {f"q{q * 100:g}".replace(".", "_"): _quantile(q) for q in quantiles}
    return sketches.select(*keys, F.kll_sketch_get_n_double("sketch").alias("num"), *[c.alias(n) for n, c in at.items()])


def _quantile(q: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))


def ranks(values: DataFrame, found: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, below and upto: the shares of each group's values that are less than found(keys, name), and no more than it. A quantile q is right within e if below - e <= q <= upto + e."""
    number = F.col(f"v.{value}").cast("double")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"v.{c}").eqNullSafe(F.col(f"f.{c}"))
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).alias("v").join(found.alias("f"), same)
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*[F.col(f"f.{c}").alias(c) for c in keys]).agg(share(number < F.col(f"f.{name}")).alias("below"), share(number <= F.col(f"f.{name}")).alias("upto"))


def store(sketches: DataFrame, path: str, batch: str) -> None:
    """Keep sketches(keys, sketch) as those of batch. A batch that is written again replaces itself, others stay as they are."""
    sketches.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of all batches, with their batch."""
    return spark.read.option("basePath", path).parquet(path)
