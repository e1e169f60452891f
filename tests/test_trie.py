"""The trie against golden counts and a plain model."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import lookup, trie

A = [10, 9, 8, 7, 6]
#: Insertions in order, and the leaves after each.
ADDED = [A, A, [*A, 4, 3, 2, 1], [*A, 999999, 3, 2, 1], [*A, 999999, 3, 2, 1, 50, 20], [*A, 12343, 3, 2, 1], [*A, 12343, 3, 99992, 18, 4], [*A, 12343, 3, 7777]]
LEAVES = [1, 1, 1, 2, 2, 3, 4, 5]


def frame(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "tokens array<int>")


def model(seqs):
    kept = {tuple(s) for s in seqs if s}
    kept = {s for s in kept if not any(len(o) > len(s) and o[: len(s)] == s for o in kept)}
    edge = {}
    for s in kept:
        for k in range(len(s)):
            edge[s[:k], s[k]] = edge.get((s[:k], s[k]), 0) + 1
    return kept, edge


def rows(edge):
    return {(tuple(r["prefix"]), r["next_token"]): r["numleaves"] for r in edge.collect()}


@pytest.mark.parametrize("k", range(len(ADDED) + 1))
def test_golden_counts(spark, k):
    assert trie.size(trie.edges(frame(spark, ADDED[:k]))) == ([0, *LEAVES])[k]


def random_sequences(seed):
    r = random.Random(seed)
    seqs = [[r.randrange(3) for _ in range(r.randrange(6))] for _ in range(40)]
    return seqs + [s + [1] for s in seqs[:5]] + seqs[:5]


@pytest.mark.parametrize("seed", range(4))
def test_against_model(spark, seed):
    seqs = random_sequences(seed)
    kept, edge = model(seqs)
    f = frame(spark, seqs)
    assert {tuple(r["tokens"]) for r in trie.maximal_leaves(f).collect()} == kept
    found = trie.edges(f)
    assert rows(found) == edge
    assert rows(trie.edges(f, depth=2)) == {k: v for k, v in edge.items() if len(k[0]) < 2}
    assert trie.recount(found).where("wrong").count() == 0
    assert trie.size(found) == len(kept)


def test_merge_commutes_and_repeats_change_nothing(spark):
    a, b = frame(spark, random_sequences(1)), frame(spark, random_sequences(2))
    ab, ba = trie.merge(a, b), trie.merge(b, a)
    assert trie.same(ab, ba) and trie.same(trie.merge(ab, ab), ab)
    assert not trie.same(ab, trie.maximal_leaves(a))


def test_other_counts(spark):
    f = frame(spark, [A, A, A[:2]])
    assert rows(trie.edges_multiplicity(f))[(), 10] == 3
    visits = {tuple(r["prefix"]): r["visits"] for r in trie.raw_visits(f).collect()}
    assert visits[()] == 3 and visits[10, 9] == 2 and visits[tuple(A)] == 0
    batches = spark.createDataFrame([(0, A), (0, A), (1, A)], "batch int, tokens array<int>")
    assert rows(trie.batch_summed(batches))[(), 10] == 2


@pytest.mark.parametrize("seed", range(2))
def test_hot_groups_are_sorted_by_ranges(spark, monkeypatch, seed):
    """All sequences share a prefix, so one group holds them all; its sort still goes over several tasks."""
    seqs = [[7, 7, 7, *s] for s in random_sequences(seed)] + [[7], [7, 7], [8], [8, 8], [8, 8]]
    want = {tuple(r["tokens"]) for r in trie.maximal_leaves(frame(spark, seqs)).collect()}
    monkeypatch.setattr(trie, "HOT", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = trie.maximal_leaves(frame(spark, seqs))
    assert {tuple(r["tokens"]) for r in got.collect()} == want and got.count() == len(want)
    longer = frame(spark, [s for s in seqs if len(s) > 2]).selectExpr("tokens[0] as t1", "tokens[1] as t2", "tokens")
    parts = longer.repartitionByRange("t1", "t2", "tokens").selectExpr("spark_partition_id() as p").distinct().count()
    assert parts > 1 and {tuple(r["tokens"]) for r in trie._ranged(longer, ["t1", "t2"]).collect()} == {t for t in want if len(t) > 2}
    batches = frame(spark, seqs).selectExpr("1 as batch", "tokens").unionByName(frame(spark, seqs).selectExpr("2 as batch", "tokens"))
    assert trie.size(trie.batch_summed(batches)) == 2 * len(want)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("text", [False, True])
def test_numbered_nodes_are_the_same_tree(spark, text):
    leaves = trie.maximal_leaves(frame(spark, random_sequences(1)))
    if text:
        leaves = leaves.select(F.transform("tokens", lambda t: F.concat(F.lit("w"), t)).alias("tokens"))
    want = Counter((r["depth"], r["next_token"], r["numleaves"]) for r in trie.edges(leaves, leaves=True).collect())
    rows = trie.compact_edges(leaves).collect()
    assert Counter((r["depth"], r["next_token"], r["numleaves"]) for r in rows) == want
    children, parents = {tuple(r["child"]) for r in rows}, {tuple(r["parent"]) for r in rows}
    assert len(children) == len(rows) and parents <= children | {(0, 0)}


def test_depth_cut_round_trip_and_dump(spark):
    f = frame(spark, ADDED)
    upper, lower = trie.depth_cut(f, 6)
    assert upper.agg(F.max("depth")).first()[0] == 5
    long_ones = trie.maximal_leaves(f).where("size(tokens) > 6")
    assert trie.same(trie.rooted(lower), long_ones)
    assert trie.dump(trie.edges(frame(spark, [[1, 2], [1, 3]]))) == "1 2\n\t2 1\n\t3 1"


@pytest.mark.parametrize("seed", range(3))
def test_next_tokens(spark, seed):
    seqs = random_sequences(seed)
    kept, edge = model(seqs)
    r = random.Random(seed)
    probes = [[r.randrange(4) for _ in range(r.randrange(7))] for _ in range(40)] + [list(s) + [0, 1] for s in kept]
    want = {}
    for q in map(tuple, probes):
        nxt = {t: n for (p, t), n in edge.items() if p == q}
        want[q] = ("OK", nxt) if nxt else ("COMPLETE" if any(q[: len(s)] == s for s in kept) else "NOT_FOUND", {})
    p = spark.createDataFrame([(q,) for q in probes], "probe array<int>")
    leaves = trie.maximal_leaves(frame(spark, seqs))
    assert {tuple(r["probe"]): (r["status"], r["next"]) for r in lookup.next_tokens(p, leaves).collect()} == want
    upper, lower = trie.depth_cut(frame(spark, seqs), 2)
    assert {tuple(r["probe"]): r["next"] for r in lookup.persisted_next_tokens(p, upper, lower, 2).collect()} == {q: n for q, (_, n) in want.items()}


def test_empty_index_and_point_reads(spark):
    p = spark.createDataFrame([([1],)], "probe array<int>")
    assert [r["status"] for r in lookup.next_tokens(p, frame(spark, []).select("tokens")).collect()] == ["EMPTY"]
    reader = lookup.PointReader(trie.edges(frame(spark, ADDED)), remember=1)
    assert reader.next([]) == {10: 5} and reader.next(A) == {4: 1, 999999: 1, 12343: 3} and reader.next([]) == {10: 5} and len(reader.answers) == 1


def test_subtract(spark):
    df = spark.createDataFrame([({1: 3, 2: 1}, {1: 1, 2: 1}), ({1: 3}, None)], "a map<int,bigint>, b map<int,bigint>")
    assert [r[0] for r in df.select(lookup.subtract("a", "b")).collect()] == [{1: 2}, {1: 3}]


@pytest.mark.parametrize("values", [1, 5])
def test_numbered_nodes_do_not_depend_on_how_many_tokens_are_numbered_at_once(spark, monkeypatch, values):
    """Sequences longer than a part are numbered over its borders (whole batches were expanded at once before)."""
    leaves = spark.createDataFrame([([str(k % m) for k in range(n)],) for n, m in ((1, 1), (13, 4), (12, 5), (7, 3), (2, 2))], "tokens array<string>").coalesce(1)
    want = sorted(map(str, trie.compact_edges(leaves).collect()))
    monkeypatch.setattr(trie, "VALUES", values)
    assert sorted(map(str, trie.compact_edges(leaves).collect())) == want and len(want) > 20
