"""Digest trees and end marks, against plain versions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import digests, lookup, trie

KIND = "tokens array<string>"


def rows(spark, facts):
    return spark.createDataFrame([(f,) for f in facts], KIND)


def plain(facts):
    kept = {tuple(f) for f in facts if f}
    kept = {f for f in kept if not any(g[: len(f)] == f and g != f for g in kept)}
    return Counter((f[:d], d, f[d]) for f in kept for d in range(len(f)))


TREES = [
    [["a", "b", "c"], ["a", "b", "d"], ["a", "x"], ["z"]],
    [["a", "b", "c"], ["a", "b", "e"], ["a", "x"], ["z"]],
    [["z"], ["a", "x"], ["a", "b", "d"], ["a", "b", "c"], ["a", "x"]],
    [["a", "b", "c", "f"], ["a", "b", "d"], ["a", "x"]],
    [["a", None], ["a", "None"]],
    [],
]


@pytest.mark.parametrize(("i", "j"), [(0, 1), (0, 2), (0, 3), (1, 3), (0, 4), (0, 5), (5, 0), (5, 5)])
def test_difference(spark, i, j):
    a, b = (digests.fold(trie.edges(rows(spark, TREES[k]))) for k in (i, j))
    found, opened = digests.difference(a, b)
    want = {(k, plain(TREES[i]).get(k), plain(TREES[j]).get(k)) for k in plain(TREES[i]) | plain(TREES[j]) if plain(TREES[i]).get(k) != plain(TREES[j]).get(k)}
    if not want:
        assert a.root == b.root and found is None and opened is None
        return
    assert a.root != b.root
    assert {((tuple(r["prefix"]), r["depth"], r["next_token"]), r["a"], r["b"]) for r in found.collect()} == want
    nodes = {(d, k[0][:d]) for k, _, _ in want for d in range(len(k[0]) + 1)}
    assert {(r["level"], r["nodes"]) for r in opened.collect()} == set(Counter(d for d, _ in nodes).items())


def test_repeated_edges_count(spark):
    edge = trie.edges(rows(spark, TREES[0]))
    assert digests.fold(edge).root != digests.fold(edge.unionByName(edge.where("depth = 2"))).root


MARKED = [["a"], ["a", "b"], ["a", "b", "c"], ["a", "b"], [], None, ["b", None], ["b", None, "c"]]


def test_marked_edges(spark):
    got = {(tuple(r["prefix"]), r["depth"], r["next_token"]): (r["numfacts"], r["ends"]) for r in trie.marked_edges(rows(spark, MARKED)).collect()}
    kept = {tuple(f) for f in MARKED if f}
    counts = Counter((f[:d], d, f[d]) for f in kept for d in range(len(f)))
    assert got == {k: (n, (*k[0], k[2]) in kept) for k, n in counts.items()}
    assert {k for k in got if k[1] < 1} == {(tuple(r["prefix"]), r["depth"], r["next_token"]) for r in trie.marked_edges(rows(spark, MARKED), depth=1).collect()}


def test_marked_lookup(spark):
    facts = [f for f in MARKED if not f or None not in f]
    probes = spark.createDataFrame([(p,) for p in ([], ["a"], ["a", "b"], ["a", "b", "c"], ["c"], ["a", "c"], ["a", "b", "c", "d"], ["a"], None)], "probe array<string>")
    got = {tuple(r["probe"]): (r["is_fact"], r["numfacts"], r["next"]) for r in lookup.marked_next_tokens(probes, rows(spark, facts)).collect()}
    assert got == {
        (): (False, 3, {"a": 3}), ("a",): (True, 3, {"b": 2}), ("a", "b"): (True, 2, {"c": 1}), ("a", "b", "c"): (True, 1, {}),
        ("c",): (False, 0, {}), ("a", "c"): (False, 0, {}), ("a", "b", "c", "d"): (False, 0, {}),
    }
    empty = lookup.marked_next_tokens(probes, rows(spark, []))
    assert empty.where(F.col("is_fact") | (F.col("numfacts") > 0) | (F.size("next") > 0)).isEmpty() and empty.count() == 7
