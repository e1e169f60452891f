"""The index that grows by batches and the path-compressed tree, against plain versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import lookup, radix, trie
from factloom.sources import incremental


def maximal(seqs):
    seqs = {tuple(s) for s in seqs if s}
    return {s for s in seqs if not any(t != s and t[: len(s)] == s for t in seqs)}


def plain_edges(leaves, switch):
    out = {}
    for s in leaves:
        for d in range(min(len(s), switch)):
            out[s[:d], s[d]] = out.get((s[:d], s[d]), 0) + 1
    return out


def frame(spark, seqs):
    return spark.createDataFrame([(list(s),) for s in seqs], "tokens array<string>")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for top in ("edges", "leaves") for d, _, names in os.walk(f"{path}/{top}") for f in names if f.endswith(".parquet")}


def stored(spark, path):
    edge = {(tuple(r["prefix"]), r["next_token"]): r["numleaves"] for r in incremental.edges(spark, path).collect()}
    return edge, {tuple(r["tokens"]) for r in incremental.leaves(spark, path).collect()}


@pytest.mark.parametrize(("seed", "switch", "head"), [(1, 3, 2), (2, 4, 1)])
def test_batches_make_the_index_of_their_union(spark, tmp_path, seed, switch, head):
    r, path = random.Random(seed), f"{tmp_path}/index"
    incremental.create(spark, path, switch, head, 5)
    seen = set()
    for k in range(3):
        batch = [[r.choice("abc") for _ in range(r.choice([0, 1, 2, 3, 5, 7]))] for _ in range(25)]
        batch += [[*s, "x"] for s in list(seen)[:4]] + [list(s)[:2] for s in list(seen)[:4]] + [list(s) for s in list(seen)[:4]]
        told = incremental.append(frame(spark, batch), path)
        before, seen = maximal(seen), seen | {tuple(s) for s in batch}
        want = maximal(seen)
        assert stored(spark, path) == (plain_edges(want, switch), want)
        assert (told["added"], told["removed"]) == (len(want - before), len(before - want))
    probes = spark.createDataFrame([(list(s[:k]),) for s in list(want)[:6] for k in range(len(s))], "probe array<string>")
    got = {tuple(x["probe"]): x["next"] for x in lookup.persisted_next_tokens(probes, incremental.edges(spark, path), incremental.suffixes(spark, path), switch).collect()}
    assert got == {p: {t: n for (q, t), n in plain_edges(want, 99).items() if q == p} for p in got}


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = f"{tmp_path}/index"
    incremental.create(spark, path, 3, 2, 50)
    incremental.append(frame(spark, [[f"s{k}", "is", f"o{k}", "end"] for k in range(40)]), path)
    first = files(path)
    told = incremental.append(frame(spark, [["s7", "is", "o7", "end"], ["s3", "is"]]), path)
    assert files(path) == first and told == {"added": 0, "removed": 0, "edges": [], "leaves": []}
    told = incremental.append(frame(spark, [["s7", "is", "o7", "end", "again"], ["s7", "is", "other"]]), path)
    after = files(path)
    changed = {os.path.dirname(f) for f, _ in set(first.items()) ^ set(after.items())}
    assert changed == {f"{path}/edges/depth={d}/bucket={b}" for d, b in told["edges"]} | {f"{path}/leaves/bucket={b}" for b in told["leaves"]}
    assert len(told["edges"]) == 3 and len(told["leaves"]) == 1  # depths 0 and 1 have one bucket


def test_a_lost_run_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/index"
    incremental.create(spark, path, 3, 2, 5)
    incremental.append(frame(spark, [["a", "b"], ["c"], ["d", "e", "f", "g"]]), path)
    whole = incremental._replace
    calls = []

    def breaks(rows, at, *by):
        calls.append(at)
        if len(calls) == 2:
            raise RuntimeError("lost")
        whole(rows, at, *by)

    monkeypatch.setattr(incremental, "_replace", breaks)
    with pytest.raises(RuntimeError):
        incremental.append(frame(spark, [["c", "c"], ["a", "b", "c"]]), path)
    monkeypatch.setattr(incremental, "_replace", whole)
    incremental.append(frame(spark, [["c", "c"]]), path)
    want = {("a", "b", "c"), ("c", "c"), ("d", "e", "f", "g")}
    assert stored(spark, path) == (plain_edges(want, 3), want)
    os.makedirs(f"{path}/pending/edges")  # a batch without a manifest
    incremental.recover(spark, path)
    assert stored(spark, path)[1] == want and not os.path.exists(f"{path}/pending")


def plain_tree(leaves):
    leaves = [tuple(s) for s in leaves]
    paths = {()} | set(leaves)
    for s in leaves:
        for t in leaves:
            if s != t:
                n = next(k for k, (x, y) in enumerate(zip(s, t, strict=False)) if x != y)
                paths.add(s[:n])
    out = []
    for p in paths:
        up = max((len(q) for q in paths if len(q) < len(p) and p[: len(q)] == q), default=-1)
        out.append((len(p), up, p[max(up, 0) :], sum(s[: len(p)] == p for s in leaves)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "letters", "n", "ranges"), [(1, "ab", 40, 1), (2, "ab", 60, 7), (3, "abcdef", 120, 9), (4, "a", 1, 3), (5, "ab", 90, 60)])
def test_compressed_tree_against_all_pairs(spark, seed, letters, n, ranges):
    r = random.Random(seed)
    given = [["z"] * r.choice([0, 3]) + [r.choice(letters) for _ in range(r.choice([1, 4, 9, 12]))] for _ in range(n)]
    given += [given[0]] * n + [given[-1][:k] for k in range(len(given[-1]))]  # a hot copy, beginnings, an empty one
    r.shuffle(given)
    leaves = maximal([g for g in given if g])
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tree = radix.compressed(frame(spark, given)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    depth = {x["node"]: x["depth"] for x in tree}
    got = sorted((x["depth"], depth[x["parent"]] if x["parent"] else -1, tuple(x["label"]), x["numleaves"]) for x in tree)
    assert got == plain_tree(leaves) and len(got) <= 2 * len(leaves)


def test_compressed_tree_of_nothing(spark):
    tree = radix.compressed(frame(spark, [[], []]))
    assert tree.count() == 0 and radix.expanded(tree) == 0


def test_labels_spell_the_whole_tree(spark):
    leaves = maximal([[x, y, "p", "q", z] for x in "ab" for y in "cd" for z in "ef"])
    df = frame(spark, leaves)
    nodes = trie.edges(df, leaves=True).select(F.concat("prefix", F.array("next_token")).alias("path")).distinct().count()
    assert radix.expanded(radix.compressed(df)) == nodes


def test_compressed_tree_of_other_tokens(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 4],), ([1, 2],), ([5],), (None,)], "tokens array<long>")
    got = {(r["depth"], tuple(r["label"]), r["numleaves"]) for r in radix.compressed(df).collect()}
    assert got == {(0, (), 3), (2, (1, 2), 2), (3, (3,), 1), (3, (4,), 1), (1, (5,), 1)}
    odd = ["\0", "\1", "", "\1\2", "\0\2", "\1\0", "\1\3"]
    got = {(r["depth"], tuple(r["label"]), r["numleaves"]) for r in radix.compressed(frame(spark, [odd, odd[:3], ["\0", "\1"], [*odd[:3], "b"]])).collect()}
    assert got == {(0, (), 2), (3, tuple(odd[:3]), 2), (7, tuple(odd[3:]), 1), (4, ("b",), 1)}
    df = frame(spark, [["a", None, 'x"y'], ["a", None], ["a", "None"]])
    got = {(r["depth"], tuple(r["label"]), r["numleaves"]) for r in radix.compressed(df).collect()}
    assert got == {(0, (), 2), (1, ("a",), 2), (3, (None, 'x"y'), 1), (2, ("None",), 1)}


@pytest.mark.parametrize(("seed", "ranges"), [(1, 1), (2, 5), (3, 40)])
def test_widths_without_a_row_for_each_token(spark, seed, ranges):
    """Edges by depth, over the borders of ranges, with repeats, beginnings of others, empty and null sequences and tokens that contain the marks."""
    r = random.Random(seed)
    seqs = [[r.choice(["a", "b", "ab", "\0", "\1", "é"]) for _ in range(r.randrange(9))] for _ in range(150)]
    seqs += [*seqs[:40], ["a"] * 50, ["a"] * 49, ["a"] * 30 + ["b"] * 30, None]
    known = {tuple(s[:k]) for s in seqs if s for k in range(1, len(s) + 1)}
    want = {d: sum(len(p) == d + 1 for p in known) for d in range(60)}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = radix.widths(spark.createDataFrame([(s,) for s in seqs], "tokens array<string>")).collect()
        none = radix.widths(spark.createDataFrame([([],), (None,)], "tokens array<string>")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {x["depth"]: x["edges"] for x in got} == want and len(got) == len(want) and none == []
