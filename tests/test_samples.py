"""Samples of exact size, whatever repeats."""

import collections
import hashlib

import pytest

from factloom.operators import qa


def first(rows, take, seed=42):
    order = lambda r: ("" if r[0] is None else hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest())
    return sorted(order(r) for r in sorted(rows, key=order)[:take])


@pytest.mark.parametrize("key", [1, 2, 7, None])
def test_one_key_for_a_whole_stratum(spark, key):
    df = spark.createDataFrame([(key, "s", k % 3) for k in range(1000)], "id long, kind string, v int")
    got = qa.stratified_sample(df, ["kind"], "id", fraction=0.2).collect()
    assert len(got) == 200
    have = collections.Counter(r["v"] for r in got)
    assert all(n <= 334 for n in have.values())


def test_unique_repeated_and_null_keys(spark):
    rows = [(k if k % 5 else None, "ab"[k % 2] if k % 11 else None, k // 40) for k in range(900)] + [(3, "a", 0)] * 300 + [(4, "b", k) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, kind string, v int").repartition(5)
    strata = collections.Counter((r[1],) for r in rows)
    for size in (0, 1, 37, 700, len(rows), 5000):
        got = [tuple(r) for r in qa.stratified_sample(df, ["kind"], "id", size=size).collect()]
        assert len(got) == min(size, len(rows))
        assert not collections.Counter(got) - collections.Counter(rows)
        want = qa.quotas(dict(strata), size=size)
        assert {k: n for k, n in want.items() if n} == dict(collections.Counter((r[1],) for r in got))
        for (kind,), n in want.items():  # the least lots
            assert first([r for r in got if r[1] == kind], n) == first([r for r in rows if r[1] == kind], n)


def test_uniform_sample_of_repeated_rows(spark):
    rows = [(1, "x")] * 500 + [(k, "y") for k in range(100)] + [(None, None)] * 9
    df = spark.createDataFrame(rows, "id long, v string")
    for n in (0, 3, 250, 609, 1000):
        got = [tuple(r) for r in qa.uniform_sample(df, n, "id").collect()]
        assert len(got) == min(n, 609) and not collections.Counter(got) - collections.Counter(rows)
        assert first(got, n) == first(rows, n)
