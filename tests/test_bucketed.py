"""The index in buckets: look-ups against plain counts, hot keys, and plans that leave the index where it is."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import lineage
from factloom.sources import bucketed

FACTS = [["a", "b", "c"], ["a", "b", "d", "e"], ["a", "b"], ["b", ".", "c"], ["b.", "c"], ["q"], ["a", "b", "c"], [], None] + [["h", "i", str(k), str(k % 3)] for k in range(40)]
PROBES = [[], ["a"], ["a", "b"], ["a", "b", "d"], ["a", "b", "c"], ["b"], ["b."], ["b", "."], ["q"], ["z"], ["h"], ["h", "i"], ["h", "i", "7"], ["h", "i", "7", "1"], ["h", "i", "7", "1", "x"], None]


def plain(probe):
    whole = {tuple(f) for f in FACTS if f}
    whole = {f for f in whole if not any(g != f and g[: len(f)] == f for g in whole)}
    out = {}
    for f in whole:
        if probe is not None and len(f) > len(probe) and list(f[: len(probe)]) == probe:
            out[f[len(probe)]] = out.get(f[len(probe)], 0) + 1
    return out


@pytest.fixture(scope="module", params=[(1, 100_000), (2, 5), (3, 1)])
def index(spark, request):
    switch, hot = request.param
    path = lineage.scratch(spark, "buckets")
    bucketed.build(spark.createDataFrame([(f,) for f in FACTS], "tokens array<string>"), path, switch, 4, hot)
    return path


def asked(spark, path):
    probes = spark.createDataFrame([(p,) for p in PROBES + PROBES[:3]], "probe array<string>")
    return bucketed.next_tokens(probes, bucketed.attach(spark, path))


def test_same_as_plain_counts(spark, index):
    got = asked(spark, index).collect()
    assert len(got) == len(PROBES)
    assert {str(r["probe"]): r["next"] for r in got} == {str(p): plain(p) for p in PROBES}


def test_a_session_without_the_tables(spark, index):
    bucketed.detach(spark, index)
    got = asked(spark, index).collect()
    assert {str(r["probe"]): r["next"] for r in got} == {str(p): plain(p) for p in PROBES}


def test_the_index_does_not_move(spark, index):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = asked(spark, index)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for name in ("edges", "suffixes"):
        at = next(i for i, x in enumerate(lines) if "FileScan" in x and bucketed._name(index, name) in x)
        assert "Bucketed: true" in lines[at], lines[at]
        above, level = [], depth(lines[at])
        for x in reversed(lines[:at]):  # from the scan up to its join
            if depth(x) < level:
                above.append(x)
                level = depth(x)
                if "Join" in x:
                    break
        assert "Join" in above[-1] and not any("Exchange" in x for x in above), above


def test_empty_index(spark):
    path = lineage.scratch(spark, "buckets")
    bucketed.build(spark.createDataFrame([], "tokens array<int>"), path, 2, 2)
    probes = spark.createDataFrame([([1],), ([],), ([1, 2, 3],)], "probe array<int>")
    assert [r["next"] for r in bucketed.next_tokens(probes, bucketed.attach(spark, path)).collect()] == [{}, {}, {}]
    assert bucketed.next_tokens(probes.where(F.lit(False)), bucketed.attach(spark, path)).isEmpty()
