"""Clusters, the conversation trie and passage removal against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from factloom.llm import centroids, dialogues, suffixes


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    cs = [x for _, x in start]
    for r in range(rounds + 1):
        of = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cs)) for _, x in kept]
        if r < rounds:
            for j in range(len(cs)):
                own = [x for (_, x), (_, o) in zip(kept, of, strict=True) if o == j]
                if own:
                    cs[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted((str(i), j, d) for (i, _), (d, j) in zip(kept, of, strict=True)), [tuple(c) for c in cs]


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.05), (2, 1.0), (3, 300.0)])
def test_clusters_against_plain_rounds(spark, seed, spread):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(9, 8))
    rows = [(k, [float(c) for c in middles[k % 9] + spread * r.normal(size=8)]) for k in range(400)]
    rows += [(k, rows[k % 50][1]) for k in range(400, 450)] + [(7, rows[7][1]), (None, rows[3][1]), (451, None), (452, [1.0]), (453, [float("nan")] * 8), (454, [None] * 8), (455, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    for bounds in (None, 1, 3):
        got, found, told = centroids.cluster(df, k=13, rounds=4, dims=8, bounds=bounds)
        want, middle = plain_clusters(rows, 13, 4, 8)
        assert sorted((str(x["id"]), x["cluster"], x["distance"]) for x in got.collect()) == want
        assert found == middle
        assert told[0]["needed"] == {12: 457 - 4 + 0}


def test_bounds_spare_distances(spark):
    r = np.random.default_rng(4)
    middles = 5 * r.normal(size=(12, 8))
    df = spark.createDataFrame([(k, [float(c) for c in middles[k % 12] + 0.3 * r.normal(size=8)]) for k in range(600)], "vec_id long, embedding array<double>")
    _, _, told = centroids.cluster(df, k=12, rounds=5, dims=8)
    assert told[-1]["needed"].get(0, 0) > 500 and told[-1]["bounds"] <= told[0]["bounds"]


def test_clusters_edge_cases(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster_digest(spark.createDataFrame([], schema)).count() == 0
    one = centroids.cluster_digest(spark.createDataFrame([(5, [0.5] * 64)], schema)).collect()
    assert [(x["vec_id"], x["cluster"], x["distance"], x["inertia"]) for x in one] == [(5, 0, 0, 0)] and one[0]["centroid_sha256"] == hashlib.sha256(",".join(["32"] * 64).encode()).hexdigest()
    nameless = centroids.cluster_digest(spark.createDataFrame([(None, [0.5] * 64)], schema)).collect()
    assert [(x["cluster"], x["distance"]) for x in nameless] == [(None, None)]
    huge = centroids.cluster_digest(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1.0] * 64)], schema)).collect()
    assert sorted(x["vec_id"] for x in huge) == [1, 2, 3] and all(x["distance"] == 0 for x in huge)
    text = centroids.cluster_digest(spark.createDataFrame([("a", [0.5] * 64), ("b", [1.5] * 64)], "vec_id string, embedding array<double>")).collect()
    assert {x["vec_id"]: x["distance"] for x in text} == {"a": 0, "b": 0}


def plain_trie(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + ts[h:])
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for node, own in members.items():
        below = [m for m in members if m[: len(node)] == node]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(rebuilt[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), sum(len(m) == len(node) + 1 for m in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def random_turns(seed, convs, most, words):
    r = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(r.choice([1, 2, 5, most])):
            rows.append((c, r.choice([t, t, t, None]) if r.random() < 0.1 else t, r.choice(["user", "bot", None]), r.choice(words)))
    return rows


@pytest.mark.parametrize(("seed", "bits"), [(1, 62), (2, 62), (3, 5), (4, 2), (5, 1)])
def test_trie_against_all_prefixes(spark, seed, bits):
    rows = random_turns(seed, range(-12, 40), 14, ["", "a", "ä", None, "long text " * 50])
    if seed in (2, 4):  # one conversation of many turns, and many of the same turns
        rows += [(100, t, "user", "a") for t in range(300)] + [(c, 0, "user", "a") for c in range(101, 160)]
    rows += rows[:20] + [(None, 1, "user", "x")]
    df = spark.createDataFrame([(*x, "e") for x in rows], "conv_id long, turn long, role string, text string, depth string").repartition(3)
    got = sorted(str((x["conv_id"], x["depth"], x["parent_conv_id"], x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"], x["ends_sha256"])) for x in dialogues.conversation_trie(df, bits).collect())
    assert got == plain_trie(rows)


def test_trie_without_conversations(spark):
    assert dialogues.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")).count() == 0


def plain_removal(docs):
    first = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        if i is not None:
            for s in range(len(b) - 49):
                w = b[s : s + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for s in range(len(b) - 49):
                if first[b[s : s + 50]] < i:
                    gone[s : s + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(i), len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéf") for _ in range(r.choice([2, 5, 9])))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (8, 9, 12, 40, 200)]
    docs = []
    for k in range(120):
        parts = [text(r.choice([0, 3, 30]))]
        for _ in range(r.choice([0, 1, 3])):
            p = r.choice(shared)
            cut = r.randrange(len(p))
            parts += [r.choice([p, p[cut:], p[:cut]]), text(r.choice([0, 1, 10]))]
        docs.append((r.choice([k, k, k, 5]), "".join(parts)))
    docs += [(200, None), (201, ""), (None, shared[4]), (202, "a" * 400), (203, "b" + "a" * 300), (204, "ab" * 200), (205, "ba" * 300), (206, "x" * 50), (207, "x" * 49), (208, "x" * 51)]
    docs += [(300 + k, docs[k][1]) for k in range(30)] + [(1000 + k, text(3) + shared[3] + text(2)) for k in range(60)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "hot", "buckets", "limits"), [(1, 4096, 1, {}), (2, 8, 3, {}), (3, 16, 2, {"CHUNK": 3000, "SLAB": 700, "BLOCK": 500, "SORTED": 40}), (4, 4096, 5, {"CHUNK": 1, "SHARD": 2000})])
def test_passages_against_all_windows(spark, monkeypatch, seed, hot, buckets, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    docs = passages(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_bytes string").repartition(3)
    got = sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in suffixes.drop_repeated_passages(df, hot, buckets).collect())
    assert got == plain_removal(docs)


def test_passages_with_other_ids_and_none(spark):
    rows = [("b", "x" * 60 + "tail"), ("a", "x" * 60), (None, "x" * 60)]
    got = {x["doc_id"]: x["n_removed"] for x in suffixes.drop_repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": 0, "b": 60, None: 0}
    assert suffixes.passage_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cover_meets_every_pair():
    for a in range(suffixes.PERIOD):
        for b in range(suffixes.PERIOD):
            s = suffixes.STEP[a, b]
            assert (a + s) % suffixes.PERIOD in suffixes.COVER and (b + s) % suffixes.PERIOD in suffixes.COVER


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_in_order(seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab" if seed < 2 else "abcdefgh") for _ in range(3000)).encode() + b"ab" * 200 + b"a" * 200
    data = np.frombuffer(text + b"\0" * 60, np.uint8)
    words = suffixes.words_of(data)
    rank = suffixes.cover_ranks(data, words)
    place = suffixes.ordered(np.arange(len(text) - 60), words, rank)
    cut = [bytes(data[p : p + suffixes.LEAST]) for p in place]
    assert cut == sorted(cut)
