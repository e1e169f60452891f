"""Sketches of quantiles: their bound, merging, batches that are written again."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import lineage, sketches


def values(spark):
    """Some 40,000 skewed values in two groups and four batches, with nulls and NaN."""
    rows = spark.range(40_000).withColumn("key", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b"))
    v = F.pmod(F.xxhash64("id"), F.lit(100_000)) ** 2 / 1e6
    return rows.select("key", (F.col("id") % 4).alias("batch"), F.when(F.col("id") % 101 == 0, None).when(F.col("id") % 103 == 0, float("nan")).otherwise(v).alias("v"))


def test_batches_merge_within_the_bound(spark):
    rows, path, qs = values(spark), lineage.scratch(spark, "sketches"), {"q1": 0.01, "q50": 0.5, "q75": 0.75, "q99_9": 0.999}
    for batch in (0, 1, 2, 3, 1):  # one twice
        sketches.store(sketches.sketch(rows.where(F.col("batch") == batch), ["key"], "v"), path, str(batch))
    found = sketches.told(sketches.merged(sketches.stored(spark, path), ["key"]), ["key"], tuple(qs.values())).cache()
    good = rows.where("v is not null and not isnan(v)")
    want = {r["key"]: (r["n"], r["a"], r["b"]) for r in good.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()}
    assert {r["key"]: (r["num"], r["min"], r["max"]) for r in found.collect()} == want and None in want
    for name, q in qs.items():
        for r in sketches.ranks(rows, found, ["key"], "v", name).collect():
            assert r["below"] - sketches.rank_error() <= q <= r["upto"] + sketches.rank_error()


def test_small_groups_are_exact(spark):
    rows = spark.createDataFrame([(1, float(k)) for k in range(101)] + [(2, 5.0)] * 7 + [(3, None)], "k int, v double")
    got = {r["k"]: (r["num"], r["q50"], r["q90"]) for r in sketches.told(sketches.sketch(rows, ["k"], "v"), ["k"], (0.5, 0.9)).collect()}
    assert set(got) == {1, 2} and got[2] == (7, 5.0, 5.0)
    assert got[1][0] == 101 and got[1][1] == pytest.approx(50, abs=1) and got[1][2] == pytest.approx(90, abs=1)


def test_empty(spark):
    assert sketches.told(sketches.sketch(spark.createDataFrame([], "k int, v int"), ["k"], "v"), ["k"]).isEmpty()
