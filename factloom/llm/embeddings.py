"""Embedding near-dedup by a forest of random-projection trees.

Each tree splits the unit vectors again and again by a random direction at the median of a sample; what lies close to a split spills into both sides.
Vectors of a leaf are compared with each other, exactly and in double precision; pairs that reach the cosine are links, and links are united.

Equal vectors are one class before, known by its content. A row of a leaf carries the vector as it came and the numbers of all its leaves, so a pair that meets in
several leaves and trees is counted in the first one only, without bringing pairs together. The more levels, the more trees, so that recall doesn't fall with depth. A leaf sends on one row for each vector with a link: how many it counted there, and the
smallest vector that links within the leaf lead to; so what leaves a group of copies grows with its members, not their pairs. Large leaves are dealt out in pairs of blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, components, grouped, labelled, map_arrow, materialize, release

#: Trees at least; vectors a leaf should hold; vectors of the sample that splits are fitted on, at most; those a node's own median needs at least.
TREES, LEAF, SAMPLE, OWN_MEDIAN = 5, 256, 4096, 16
#: About how often a split parts a pair that just links, measured on random pairs; how many such pairs may be parted in all trees.
PARTED, MISSED = 0.021, 0.001
#: Classes of a large leaf's block; pairs that are looked at once; earlier leaves, and pairs, that are looked at once for a common one.
BLOCK, PAIRS, COLUMNS = 1024, 1 << 18, 4096


def unit(x: list | None) -> np.ndarray | None:
    """The vector in double precision and of length 1; None if it is null, empty, zero, or holds null or non-finite components."""
    if not x or any(c is None for c in x):
        return None
    v = np.array(x, np.float64)
    top = np.abs(v).max()
    return scaled(v) if np.isfinite(top) and top > 0 else None


def scaled(v: np.ndarray) -> np.ndarray:
    """A finite vector other than zero, at length 1."""
    v = v / np.abs(v).max()  # squares neither overflow nor vanish
    return v / np.sqrt(v @ v)


class Forest:
    """Splits of every tree: one random direction for each level, and a threshold for each node that enough sampled vectors reach, else the level's."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float, trees: int | None = None, seed: int = 11):
        dims = sample.shape[1]
        self.levels = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        parted = 1 - (1 - PARTED) ** self.levels
        trees = self.trees = trees or max(TREES, int(np.ceil(np.log(MISSED) / np.log(parted))) if parted > 0 else 0)
        self.number = np.dtype("<u4" if self.levels < 31 else "<u8")  # of a leaf
        self.margin = 0.5 * np.sqrt(2 - 2 * cosine) / np.sqrt(dims)  # half the spread of the projections of a pair just linked
        rng = np.random.default_rng(seed)
        d = rng.normal(size=(dims, trees, self.levels))
        self.directions = (d / np.linalg.norm(d, axis=0)).reshape(dims, -1)
        p = (sample @ self.directions).reshape(len(sample), trees, self.levels)
        self.middle = np.median(p, axis=0) if len(p) else np.zeros((trees, self.levels))
        self.own: list[list[dict[int, float]]] = []
        for t in range(trees):
            node, per_level = np.ones(len(p), np.int64), []
            for k in range(self.levels):
                x, found = p[:, t, k], {}
                order = np.argsort(node, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    if len(part) >= OWN_MEDIAN:
                        found[int(node[part[0]])] = float(np.median(x[part]))
                per_level.append(found)
                cut = np.array([found.get(int(i), self.middle[t, k]) for i in node])
                node = 2 * node + (x >= cut)
            self.own.append(per_level)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of x, trees and leaves: each vector with all leaves that it reaches."""
        p = (x @ self.directions).reshape(len(x), self.trees, self.levels)
        rows, trees, leaves = [], [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for k in range(self.levels):
                own, middle = self.own[t][k], self.middle[t, k]
                distinct, where = np.unique(node, return_inverse=True)
                away = p[row, t, k] - np.array([own.get(int(i), middle) for i in distinct])[where]
                left, right = away < self.margin, away >= -self.margin
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            trees.append(np.full(len(row), t))
            leaves.append(node)
        return np.concatenate(rows), np.concatenate(trees), np.concatenate(leaves)


def pack_paths(forest: Forest, n: int, row: np.ndarray, tree: np.ndarray, leaf: np.ndarray) -> list[bytes]:
    """For each of n rows: how many leaves it has in each tree, then their numbers."""
    order = np.lexsort((leaf, tree, row))
    row, tree, leaf = row[order], tree[order], leaf[order].astype(forest.number)
    counts = np.bincount(row * forest.trees + tree, minlength=n * forest.trees).reshape(n, -1).astype("<u2")
    edges = np.searchsorted(row, np.arange(n + 1))
    return [c.tobytes() + leaf[s:e].tobytes() for c, s, e in zip(counts, edges, edges[1:], strict=False)]


def unpack_paths(packed: list[bytes], trees: int, number: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Counts (row, tree) and leaf numbers, row by row and tree by tree."""
    counts = np.frombuffer(b"".join([p[: 2 * trees] for p in packed]), "<u2").reshape(-1, trees).astype(np.int64)
    return counts, np.frombuffer(b"".join([p[2 * trees :] for p in packed]), number).astype(np.int64)


class Earlier:
    """Whether pairs of a leaf's rows share a leaf of an earlier tree, or a smaller one of this tree, by bits: a column for each such leaf that holds two rows or more.

    Columns are taken COLUMNS at a time and pairs by as many, so memory is bounded however many leaves a vector spilled into.
    """

    def __init__(self, paths: np.ndarray, tree: int, leaf: int):
        self.n, before = len(paths), paths[:, : tree + 1] >= 0
        before[:, tree] &= paths[:, tree] < leaf
        row, of, _ = np.nonzero(before)
        own = paths[:, : tree + 1][before]
        order = np.lexsort((own, of))
        row, of, own = row[order], of[order], own[order]
        column = np.cumsum(np.concatenate([[True], (of[1:] != of[:-1]) | (own[1:] != own[:-1])])[: len(row)]) - 1
        several = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
        self.row, self.column = row[several], np.unique(column[several], return_inverse=True)[1]

    def met(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for first in range(0, int(self.column[-1]) + 1 if len(self.column) else 0, COLUMNS):
            s, e = np.searchsorted(self.column, (first, first + COLUMNS))
            bits = np.zeros((self.n, COLUMNS), bool)
            bits[self.row[s:e], self.column[s:e] - first] = True
            words = np.packbits(bits, axis=1).view(np.uint64)
            left = np.flatnonzero(~out)
            for at in range(0, len(left), COLUMNS):
                k = left[at : at + COLUMNS]
                out[k] = (words[i[k]] & words[j[k]]).any(1)
        return out


def compare(x: np.ndarray, weight: np.ndarray, paths: np.ndarray, tree: int, leaf: int, cosine: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of a leaf's vectors: weights of the links first met here, and the smallest row that links lead to. own: if given, only pairs of different blocks count."""
    n = len(x)
    links, root = np.zeros(n, np.int64), np.arange(n)
    found_i, found_j = [], []
    earlier = Earlier(paths, tree, leaf)
    step = max(1, PAIRS // n)
    for at in range(0, n, step):
        i, j = np.nonzero(x[at : at + step] @ x.T >= cosine)
        i = i + at
        keep = i < j
        if own is not None:
            keep &= own[i] != own[j]
        i, j = i[keep], j[keep]
        found_i.append(i)
        found_j.append(j)
        new = ~earlier.met(i, j)
        np.add.at(links, i[new], weight[j[new]])
        np.add.at(links, j[new], weight[i[new]])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    while len(i):  # smallest labels spread over links until none changes
        low = np.minimum(root[i], root[j])
        if (root[i] == low).all() and (root[j] == low).all():
            break
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
    return links, root


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", trees: int | None = None) -> DataFrame:
    """For each row of vectors(vec_id, embedding): vec_id, n_links (other vectors linked directly), component_id (smallest vec_id that links lead to), kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different lengths with each other. Rows that repeat vec_id
    and vector are one vector; rows that share a vec_id only are judged each by its own vector. A null vec_id has no links and no component, and is kept. An empty table gives
    an empty result. Other columns are ignored. Splits are fitted on SAMPLE vectors at most; every vector is indexed, and every pair that shares a leaf is compared.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    number = np.dtype("<f4") if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else np.dtype("<f8")
    source = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("embedding"))

    def classify(batches):
        for b in batches:
            c1, c2, x = [], [], []
            for v in b.column(1).to_pylist():
                u = unit(v)
                h = hashlib.blake2b(b"" if u is None else u.tobytes(), digest_size=16).digest()
                c1.append(None if u is None else int.from_bytes(h[:8], "little", signed=True))
                c2.append(None if u is None else int.from_bytes(h[8:], "little", signed=True))
                x.append(None if u is None else np.array(v, number).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(x, pa.binary())], names=["vec_id", "c1", "c2", "x"])

    units = materialize(map_arrow(source, classify, f"vec_id {kind}, c1 long, c2 long, x binary"), "units")
    linkable = units.where("x is not null and vec_id is not null")
    classes = linkable.groupBy("c1", "c2").agg(F.min("vec_id").alias("doc"), F.countDistinct("vec_id").alias("weight"), F.first("x").alias("x"), F.length(F.first("x")).alias("size"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so numbers stay
    found = []
    for size in _lengths(classes):  # almost always one length
        own = classes.where(F.col("size") == size)
        n = own.count()
        lot = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(min(1.0, 0.9 * SAMPLE / n) * (1 << 20)) + 1
        sample = _units([r["x"] for r in own.where(lot).orderBy("node").limit(SAMPLE).select("x").collect()], number, size)
        found.append(_leaf_links(own, Forest(sample, n, cosine, trees), cosine, number))
    links = found[0] if found else spark.createDataFrame([], "node long, links long, root long")
    for f in found[1:]:
        links = links.union(f)
    links = materialize(links, "leaf-links")
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(links.select("node", "root"))
    release(*found)
    known = (
        classes.join(sums, "node", "left").join(labelled(linked, classes).drop("component"), "node", "left")
        .select("c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "doc").alias("component_id"))
    )
    joined = linkable.select("vec_id", "c1", "c2").join(known, ["c1", "c2"]).select("vec_id", "n_links", "component_id")
    rest = units.where("x is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _units(raw: list[bytes], number: np.dtype, size: int) -> np.ndarray:
    """Unit vectors of raw ones."""
    rows = np.frombuffer(b"".join(raw), number).reshape(len(raw), -1).astype(np.float64)
    return np.array([scaled(v) for v in rows]).reshape(-1, size // number.itemsize)


def _lengths(classes: DataFrame) -> list[int]:
    """All sizes that two classes or more have; a class alone in its size has nothing to link with."""
    return [r["size"] for r in classes.groupBy("size").count().where("count > 1").orderBy("size").collect()]


def _leaf_links(classes: DataFrame, forest: Forest, cosine: float, number: np.dtype) -> DataFrame:
    """Written: node, links and root of the classes that have links in a leaf."""
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def find(batches):
        forest = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                raw = b.column(2).to_pylist()
                row, tree, leaf = forest.leaves(_units(raw, number, len(raw[0])))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pack_paths(forest, len(raw), row, tree, leaf), pa.binary())], names=["node", "weight", "x", "paths"])

    def places(paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        forest = shared.value
        counts, leaf = unpack_paths(paths.to_pylist(), forest.trees, forest.number)
        return np.repeat(np.arange(len(counts)), counts.sum(1)), np.repeat(np.tile(np.arange(forest.trees), len(counts)), counts.ravel()), leaf

    def count(batches):
        for b in batches:
            _, tree, leaf = places(b.column(0))
            key, n = np.unique(np.stack([tree, leaf]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key[0].astype(np.int32)), pa.array(key[1]), pa.array(n)], names=["tree", "leaf", "members"])

    def spread(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                row, tree, leaf = places(b.column(3))
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(leaf), *(c.take(pa.array(row)) for c in b.columns)], names=["tree", "leaf", "node", "weight", "x", "paths"])

    # each vector is written once with its leaves, and goes to each leaf once; only leaves of several blocks are looked up, and they are few
    rows = materialize(classes.select("node", "weight", "x").mapInArrow(find, "node long, weight long, x binary, paths binary"), "paths")
    sizes = rows.select("paths").mapInArrow(count, "tree int, leaf long, members long").groupBy("tree", "leaf").agg(F.sum("members").alias("members"))
    large = materialize(sizes.where(F.col("members") > BLOCK).select("tree", "leaf", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "large")
    dealt = rows.mapInArrow(spread, "tree int, leaf long, node long, weight long, x binary, paths binary").join(large, ["tree", "leaf"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("tree", "leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "weight", "x", "paths")

    def run(batches):
        forest = shared.value
        for t in grouped(batches, 4):
            if t.num_rows < 2:
                continue
            tree, leaf, a, b = (t[c][0].as_py() for c in ("tree", "leaf", "a", "b"))
            node, weight, own = (t[c].to_numpy() for c in ("node", "weight", "own"))
            raw = t["x"].to_pylist()
            counts, leaves = unpack_paths(t["paths"].to_pylist(), forest.trees, forest.number)
            flat = counts.ravel()
            paths = np.full((len(node), forest.trees, counts.max()), -1, np.int64)
            at = np.repeat(np.arange(len(flat)), flat)
            paths.reshape(len(flat), -1)[at, np.arange(len(at)) - np.repeat(np.cumsum(flat) - flat, flat)] = leaves
            links, root = compare(_units(raw, number, len(raw[0])), weight, paths, tree, leaf, cosine, own if a != b else None)
            keep = (links > 0) | (root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links[keep]), pa.array(node[root[keep]])], names=["node", "links", "root"])

    keys = ["tree", "leaf", "a", "b"]
    out = materialize(dealt.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "node long, links long, root long"), "links")
    release(rows, large)
    return out


ORACLE_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS x,
    coalesce(len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_max(list_transform(embedding::DOUBLE[], lambda c: abs(c))) > 0, false) AS fit
  FROM embeddings),
links AS (
  SELECT v.vec_id AS a, w.vec_id AS b FROM vectors v JOIN vectors w ON v.vec_id <> w.vec_id AND v.fit AND w.fit AND len(v.x) = len(w.x)
  WHERE list_cosine_similarity(v.x, w.x) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM vectors UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM vectors LEFT JOIN degree ON degree.a = vec_id JOIN least ON least.a = vec_id
"""
