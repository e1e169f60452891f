"""The Jaccard join, the embedding forest, components and the pipeline against plain versions."""

import random

import numpy as np
import pytest
from brute import dedup_lines, jaccard_components, unite
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import embeddings, jaccard, secrets
from factloom.llm.common import components


def test_components_against_union_find(spark):
    r = random.Random(1)
    for n, m in ((30, 20), (60, 70), (200, 190)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
        want = unite({x for p in links for x in p}, links)
        got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert all(got.get(k, k) == v for k, v in want.items()) and set(got) <= set(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(seed, groups=12, size=8):
    """Documents with exact and near copies, shared passages, and short ones."""
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(3000))
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([5, 8, 20, 60, 300]))]
        for _ in range(r.randrange(1, size)):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
            docs.append(" ".join(copy).upper())
    for _ in range(20):
        docs.append(" ".join([word() for _ in range(20)] + passage + [word() for _ in range(r.choice([3, 10, 40]))]))
    docs += ["a b c d e f g h"] * 3 + ["a b c d e f g x", "one", "ONE ", "one two three", "", " \n", "x y z", "a\x1cb c", "ı İ"]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "words", "num", "den"), [(1, 4, 85, 100), (2, 5, 80, 100), (3, 4, 85, 100)])
def test_jaccard_against_all_pairs(spark, monkeypatch, seed, words, num, den):
    if seed == 3:  # cells in blocks
        monkeypatch.setattr(jaccard, "BLOCK", 3)
    docs = near_copies(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_shingles string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(df, jaccard.Similarity(words, num, den)).collect()}
    assert got == jaccard_components(docs, words, num, den)


def test_jaccard_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e"), (3, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "q " * 5000)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.jaccard_groups(df).collect())
    assert got == [("1", 0, "1"), ("2", 0, "2"), ("3", 2, "3"), ("4", 2, "3"), ("4", 2, "3"), ("5", 1, "5"), ("None", 2, "None")]
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


def test_a_null_row_hides_no_near_copy(spark):
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "x"])
    df = spark.createDataFrame([(None, text), (3, text), (10, near), (None, near)], "doc_id long, text string").coalesce(1)
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard.jaccard_groups(df).collect())
    assert got == [("10", "3"), ("3", "3"), ("None", "None"), ("None", "None")]


def test_an_id_with_two_texts_links_nothing(spark):
    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"o{k}" for k in range(60))
    df = spark.createDataFrame([(0, near), (1, text), (1, other), (1, other), (5, other + " y")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_groups(df).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (1, 1), (5, 1)]


def test_first_search_of_a_tree():
    rng = np.random.default_rng(5)
    sim = jaccard.Similarity(4, 85, 100)
    for size in (2, 9, 90):
        base = rng.integers(0, 6, (6, jaccard.GROUPS))
        points = np.concatenate([np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0) for _ in range(40)]).astype(np.uint8)[:size]
        n = points.sum(1).astype(np.int64)
        got = set(zip(*jaccard.nearest(points, n, sim), strict=True))
        want = set()
        for i in range(size):
            near = []
            for j in range(size):
                both = int(np.minimum(points[i], points[j]).sum())
                if i != j and both * 185 >= 85 * (n[i] + n[j]) and n[i] * 100 >= 85 * n[j] and n[j] * 100 >= 85 * n[i]:
                    near.append((-both / (n[i] + n[j]), j))
                    if min(i, j) < jaccard.HUBS:
                        want.add((min(i, j), max(i, j)))
            for side in ([x for x in near if x[1] > i], [x for x in near if x[1] < i]):
                want |= {(min(i, j), max(i, j)) for _, j in sorted(side)[: jaccard.NEAREST]}
        assert got == want


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    for trial in range(5):
        base = rng.integers(0, 6, (12, jaccard.GROUPS))
        points = np.concatenate([np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0) for _ in range(12)]).astype(np.uint8)
        sizes, component = points.sum(1).astype(np.int64), rng.integers(0, 20, len(points)) if trial else np.arange(len(points))
        found = {(min(i, j), max(i, j)) for a, b in jaccard.CountTree(points, sizes, component).pairs(85, 100) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        for i in range(len(points)):
            for j in range(i + 1, len(points)):
                both = int(np.minimum(points[i], points[j]).sum())
                if component[i] != component[j] and both * 185 >= 85 * (sizes[i] + sizes[j]):
                    assert (i, j) in found


def test_fine_bounds_never_fall_short():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 5, 200, 260, 900, 1100, 4000)]
    fine = [jaccard.fine_counts(s) for s in sets]
    i, j = np.triu_indices(len(sets), 1)
    for bound, a, b in zip(jaccard.fine_bounds(fine, i, j), i, j, strict=True):
        assert bound >= len(np.intersect1d(sets[a], sets[b]))


def vectors(seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(600, 48))
    near = base[:200] + rng.normal(size=(200, 48)) * rng.uniform(0.02, 0.06, (200, 1)) * np.linalg.norm(base[:200], axis=1)[:, None]
    hot = base[0] + rng.normal(size=(150, 48)) * 0.02
    return [v.tolist() for v in np.concatenate([base, near, hot, base[:20], 3 * base[20:30]])]


@pytest.mark.parametrize("block", [2048, 40])
def test_forest_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "LEAF", 32)
    v = vectors(5)
    rows = [(k, x, 0) for k, x in enumerate(v)]
    odd = [(9000, None, 0), (9001, [0.0] * 48, 0), (9002, [float("inf")] + [1.0] * 47, 0), (9003, [None] + [1.0] * 47, 0), (9004, [], 0), (9005, [1.0, 2.0], 0), (9006, [2.0, 4.0], 0), (None, v[0], 0), (3, v[3], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, kept int").repartition(3)).collect()
    u = np.array([x / np.linalg.norm(x) for x in map(np.array, v)])
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd)
    links = np.array([by[k]["n_links"] for k in range(len(v))])
    assert (links <= s.sum(1)).all() and links.sum() >= 0.99 * s.sum()
    if (links == s.sum(1)).all():
        want = unite(range(len(v)), zip(*np.nonzero(s), strict=True))
        assert all(by[k]["component_id"] == want[k] and by[k]["kept"] == (want[k] == k) for k in range(len(v)))
    assert all(by[k]["n_links"] == 0 and by[k]["component_id"] == k for k in range(9000, 9005))
    assert by[9005]["n_links"] == by[9006]["n_links"] == 1 and by[9006]["component_id"] == 9005 and by[None]["n_links"] == 0


@pytest.mark.parametrize("levels", [8, 16, 22])
def test_recall_does_not_fall_with_depth(levels):
    rng = np.random.default_rng(levels)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.95, 0.96, len(x))[:, None]
    y = cosine * x + np.sqrt(1 - cosine**2) * side
    forest = embeddings.Forest(x[: embeddings.SAMPLE], embeddings.LEAF << levels, 0.95)
    assert forest.levels == levels
    pairs = slice(embeddings.SAMPLE, None)
    met = [set() for _ in range(len(x) - embeddings.SAMPLE)]
    for row, tree, leaf in zip(*forest.leaves(x[pairs]), strict=True):
        met[row].add((tree, leaf))
    found = np.zeros(len(met), bool)
    for row, tree, leaf in zip(*forest.leaves(y[pairs]), strict=True):
        found[row] |= (tree, leaf) in met[row]
    assert found.mean() >= 0.99


def test_an_id_with_two_vectors_links_nothing(spark):
    v, near, far = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    got = embeddings.near_duplicates(spark.createDataFrame([(0, v), (1, near), (1, far), (2, far)], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(0, 1, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1)]


def test_paths_come_back():
    forest = embeddings.Forest(np.random.default_rng(1).normal(size=(100, 8)), 20000, 0.95, trees=3)
    row, tree, leaf = forest.leaves(np.random.default_rng(2).normal(size=(7, 8)))
    counts, leaves = embeddings.unpack_paths(embeddings.pack_paths(forest, 7, row, tree, leaf), 3, forest.number)
    back = set(zip(np.repeat(np.arange(7), counts.sum(1)), np.repeat(np.tile(np.arange(3), 7), counts.ravel()), leaves, strict=True))
    assert back == set(zip(row, tree, leaf, strict=True)) and len(leaves) == len(row)


def test_vectors_of_more_than_a_thousand_lengths(spark):
    assert len(embeddings._lengths(spark.range(2200).selectExpr("id % 1100 as size"))) == 1100
    rows = [(k, [1.0] * k) for k in range(1, 1101)] + [(2000, [1.0] * 1099 + [1.01])]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1100] == got[2000] == 1 and sum(got.values()) == 2


def test_forest_of_nothing(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    u = np.array([embeddings.unit(r["embedding"]) for r in rows])
    true = (u @ u.T >= 0.95).sum() - len(u)
    assert sum(r["n_links"] for r in embeddings.near_duplicates(df).collect()) >= 0.9 * true


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf).cache()
    assert good.columns == columns and set(rows(good)) <= set(rows(docs))
    unique = stages["lines"](spark, good, sf).cache()
    assert unique.columns == columns and rows(unique) == sorted((i, t) for i, _, _, t in dedup_lines(rows(good)))
    one = stages["near_duplicates"](spark, unique, sf).cache()
    want = jaccard_components(rows(unique), 5, 80, 100)
    assert rows(one) == [(i, t) for i, t in rows(unique) if want[i][1] == i]
    safe = stages["secrets"](spark, one, sf).cache()
    assert safe.columns == columns and rows(safe) == [(i, secrets.redact(t)) for i, t in rows(one)]
    assert all(r["n_chars"] == len(r["text"]) for r in safe.collect())
    packed = stages["packing"](spark, safe, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {i for i, _ in rows(safe)}


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark, sf):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, one), (5, two), (5, two), (3, one + " x"), (9, two + " x"), (12, "some other text"), (12, "and one more"), (None, one)]
    df = spark.createDataFrame([(*r, "en", "s", 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    got = sorted(((r["doc_id"], r["text"]) for r in stages["near_duplicates"](spark, df, sf).collect()), key=str)
    assert got == sorted([(3, one + " x"), (5, two), (12, "some other text"), (12, "and one more"), (None, one)], key=str)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r["doc_id"] for r in stages["quality"](spark, docs, sf).select("doc_id").collect()}
    bad = min(r["doc_id"] for r in docs.select("doc_id").collect() if r["doc_id"] not in good)
    shared = docs.withColumn("doc_id", F.when(F.col("doc_id") == bad, min(good)).otherwise(F.col("doc_id")))
    assert stages["quality"](spark, shared, sf).where(F.col("doc_id") == min(good)).count() == 1


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = ["__rejected", "__digest", "__gone", "__drops", "__of", "__id", "__n_lines", "__n_dropped", "__first", "digest", "n", "kept", "component", "first", "row", "host", "path", "d", "m", "r"]
    df = docs.select("*", *[F.col("doc_id").alias(c) for c in odd]).cache()
    df = df.unionByName(df.where("doc_id % 4 = 0")).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        df = stage(spark, df, sf).cache()
        assert df.columns == docs.columns + odd, name
        assert df.where("doc_id is not null").where(" or ".join(f"`{c}` <> doc_id" for c in odd)).isEmpty() and df.where("doc_id is null").count() == 1
    assert df.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def test_run_releases_what_it_wrote(spark, sf):
    import os

    top = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://") + "/factloom"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    out = corpus_pipeline.run(spark, sf)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(top)) - before}
    assert out.count() and left <= {"pipeline-secrets", "pieces", "chunks", "units", "patterns"}, left


def test_pipeline_repeated_and_null_rows(spark, sf):
    text = "some words that make up a document of a fair length, to be kept as it is\nanother line of it here"
    df = spark.createDataFrame([(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text + " more", "en", "s", 9), (None, None, None, None, None), (None, text, None, None, None), (7, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        df = stage(spark, df, sf).cache()
    assert sorted(str(r["doc_id"]) for r in df.collect()) in (["1", "7", "None", "None"], ["1", "None", "None"])
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pairs_of_many_common_leaves_are_compared_in_bounded_memory():
    """Rows that spilled into a hundred and fifty leaves of each tree: the first leaf of each pair is found, in a few MB (2,361 before for a leaf of 750)."""
    import tracemalloc

    rng = np.random.default_rng(2)
    n, trees, most = 400, 3, 150
    paths = np.full((n, trees, most), -1, np.int64)
    for r in range(n):
        for t in range(trees):
            own = np.sort(rng.choice(6000, rng.integers(1, most + 1), replace=False)) + 2
            paths[r, t, : len(own)] = own
    paths[:, 2, 0] = 3000
    x = np.tile([1.0, 0.0], (n, 1))
    tracemalloc.start()
    links, root = embeddings.compare(x, np.ones(n, np.int64), paths, 2, 3000, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    before = [{(t, leaf) for t in range(trees) for leaf in paths[r, t] if leaf >= 0 and (t < 2 or leaf < 3000)} for r in range(n)]
    assert links.tolist() == [sum(before[r].isdisjoint(before[o]) for o in range(n) if o != r) for r in range(n)]
    assert 0 < links.sum() < n * (n - 1) and not root.any()
    assert peak < 100 << 20
