"""Time-series arithmetic over throughput logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lineage


def elapsed(events: DataFrame, keys: list[str], ts: str, order: list[str] | None = None) -> DataFrame:
    """keys, ts and seconds since the row before; the first row of a key gives none."""
    w = Window.partitionBy(*keys).orderBy(*(order or [ts]))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = events.withColumn("__before", F.lag(ts).over(w)).where("__before is not null")
    return rows.withColumn("seconds", (micros(F.col(ts)) - micros(F.col("__before"))) / 1e6).drop("__before")


def moving_average(series: DataFrame, keys: list[str], order: list[str], value: str, width: int = 10) -> DataFrame:
    """The mean of the last width values, for rows that have as many."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = series.withColumn("__n", F.row_number().over(w)).withColumn("moving_avg", F.avg(value).over(w.rowsBetween(1 - width, 0)))
    return rows.where(F.col("__n") >= width).drop("__n")


def running_sum(series: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The position from 0, and the sum so far."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return series.withColumn("position", (F.row_number().over(w) - 1).cast("long")).withColumn("cumsum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def ranked_quantiles(values: DataFrame, keys: list[str], value: str, quantiles: tuple[float, ...]) -> DataFrame:
    """keys and one column for each of quantiles, exact and interpolated, of the values that aren't null.

    Values are counted, sorted by ranges over all tasks, and each range's offset is the number of rows of its key in the ranges before; so no task holds a key's values.
    """
    some = values.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v")).agg(F.count("*").alias("n"))
    own = [f"k{i}" for i in range(len(keys))]
    local = lineage.cut(some.repartitionByRange(*own, "v").withColumn("part", F.spark_partition_id()))  # ranges hold only as long as rows don't move
    parts = local.groupBy(*own, "part").agg(F.sum("n").alias("m"))  # keys of a range: few rows where a key spreads over ranges
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*own, F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*own, "part", before.alias("before"), F.sum("m").over(Window.partitionBy(*own, F.lit(0))).alias("total"))
    same = F.lit(True)
    for k in (*own, "part"):
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"p.{k}"))
    rows = local.alias("l").join(parts.alias("p"), same).select("l.*", "p.before", "p.total")
    last = F.col("before") + F.sum("n").over(Window.partitionBy("part", *own).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - 1
    ranked = rows.withColumn("last", last).withColumn("first", F.col("last") - F.col("n") + 1)
    aggregates = []
    for i, q in enumerate(quantiles):
        place = (F.col("total") - 1) * F.lit(q)
        low, high = F.floor(place), F.ceil(place)
        at = lambda p: F.max(F.when((F.col("first") <= p) & (p <= F.col("last")), F.col("v").cast("double")))
        a, b = at(low), at(high)
        aggregates.append((a + (b - a) * F.max(place - low)).alias(f"q{i}"))
    return ranked.groupBy(*own).agg(*aggregates)


def summary(series: DataFrame, value: str, keys: list[str] = (), quantiles: tuple[float, ...] = (0.75,)) -> DataFrame:
    """max, min, avg, sum, num and exact quantiles (q75 and so on) of a series, by keys if given."""
    keys = list(keys)
    sums = series.groupBy(*keys).agg(F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("avg"), F.sum(value).alias("sum"), F.count(value).alias("num"))
    q = ranked_quantiles(series, keys, value, quantiles)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & sums[k].eqNullSafe(q[f"k{i}"])
    return sums.join(q, same, "left").select(*sums.columns, *[F.col(f"q{i}").alias(f"q{x * 100:g}".replace(".", "_")) for i, x in enumerate(quantiles)])
