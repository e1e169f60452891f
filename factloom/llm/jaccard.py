"""N-gram Jaccard join through a count-vector R-tree.

A document's set of word shingles is hashed into groups; the counts of the groups are a point. The overlap of two sets is at most
the sum of the coordinates' minima, and for two boxes at most that sum of their upper corners, so an R-tree over points drops pairs of
boxes, then of points, that can't reach the similarity. What survives is verified on the sets themselves.

Counts of hashed shingles alone can't split a corpus between machines: all points of a size lie close together, and the tree would compare all
with all. So trees are built in cells: a set goes into the cells of its rarest shingles, as many (all but the least overlap, plus one) that
two similar sets meet in a cell for certain, whatever order "rarest" has; a sample of documents finds the frequent shingles that go last.
Equal sets are one class before, known by 128 bits of its content. In cells of more than LEAF classes candidates come out of a tree, in smaller ones all pairs are held against the same bounds. There are two searches: the first takes what may link
with the cell's first classes, by doc_id, and for each class the nearest few, by their bound, which joins groups of near copies with as many pairs as a few times their members;
the second takes all pairs that may link and still lie in different components. No cell is cut short; a large one is dealt out in blocks, for the second search in pairs of blocks.
"""

from __future__ import annotations

import hashlib
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, components, grouped, labelled, map_arrow, materialize, mix64, release

#: Groups of shingles, that is dimensions of the tree; points of a leaf; children of a box.
GROUPS, LEAF, FAN = 64, 16, 8
#: The largest count of a point, which stands for any larger one, too.
OPEN = 255
#: Frequent shingles that go last in the order, at most; the part of the documents that is sampled for them, and how many documents at least.
FREQUENT, SAMPLE_PART, SAMPLE_LEAST = 200_000, 1 / 32, 8192
#: Classes of a cell's block; first classes of a block, and nearest ones of each class, that the first search takes.
BLOCK, HUBS, NEAREST = 1024, 1, 3
#: Documents up to which the ids of those to verify are broadcast (16 bytes each).
BROADCAST_IDS = 1_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:  # longer ones rarely come again, and would fill a worker's memory
            if len(self) > 500_000:
                self.clear()
            self[word] = h
        return h


_words = _Words()


class Similarity(NamedTuple):
    """Shingles of so many words; sets link when den * intersection >= num * union."""

    words: int
    num: int
    den: int

    def prefix(self, n: int) -> int:
        """Shingles in rarest-first order of which two linked sets share one."""
        return n - -(-self.num * n // self.den) + 1 if n else 0


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence if there are fewer words; none without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out * _MULTIPLIERS[i % 4] + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def content(s: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a set, as two signed words."""
    return struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16).digest())


def counts(s: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=GROUPS), OPEN).astype(np.uint8)


def fine_counts(s: np.ndarray) -> bytes:
    """Counts of at least half as many groups as shingles, a power of two of 128 at least, two in a byte; 15 stands for any larger number."""
    bits = max(7, int(len(s) - 1).bit_length() - 1) if len(s) else 7
    c = np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return (c[::2] | c[1::2] << 4).tobytes()


def fine_bounds(fine: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs (i, j) of sets with these fine_counts, at least their overlap. The finer counts of a pair are folded to the coarser ones."""
    lengths = np.array([2 * len(x) for x in fine])
    low = np.minimum(lengths[i], lengths[j])
    out = np.empty(len(i), np.int64)
    for level in np.unique(low):
        rows = np.flatnonzero(low == level)
        own = np.unique(np.concatenate([i[rows], j[rows]]))
        folded = np.empty((len(own), level), np.int16)
        for n in np.unique(lengths[own]):
            at = np.flatnonzero(lengths[own] == n)
            packed = np.frombuffer(b"".join(fine[k] for k in own[at]), np.uint8).reshape(len(at), -1)
            x = np.stack([packed & 15, packed >> 4], 2).reshape(len(at), level, -1).astype(np.int16)
            folded[at] = np.minimum(np.where(x == 15, 8192, x).sum(2), 16384)
        a, b = np.searchsorted(own, i[rows]), np.searchsorted(own, j[rows])
        step = max(1, (1 << 21) // int(level))
        for k in range(0, len(rows), step):
            out[rows[k : k + step]] = np.minimum(folded[a[k : k + step]], folded[b[k : k + step]]).sum(1, dtype=np.int64)
    return out


def open_ended(points: np.ndarray) -> np.ndarray:
    """Counts of which OPEN stands for any larger number."""
    return np.where(points == OPEN, 1 << 28, points).astype(np.int32)


class CountTree:
    """An R-tree over count vectors, packed bottom-up from points sorted by size and by their most varying coordinate.

    counts (points, groups); sizes, true set sizes; component, of which points of one need not be compared. Counts of OPEN stand for any larger number.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        points = open_ended(points)
        slab = np.argsort(sizes, kind="stable").argsort(kind="stable") // (LEAF * FAN)
        order = np.lexsort((points[:, points.var(0).argmax()], slab))
        self.order, self.points, self.sizes, self.component = order, points[order], sizes[order].astype(np.int64), component[order]
        self.levels = [(self.points, self.sizes, self.sizes, self.component, self.component)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            top, low, high, c0, c1 = self.levels[-1]
            at = np.arange(0, len(top), step)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))
            step = FAN
        self.steps = [LEAF, *[FAN] * len(self.levels)]

    def _survive(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        top, low, high, c0, c1 = self.levels[level]
        keep = (high[i] * den >= low[j] * num) & (high[j] * den >= low[i] * num) & ~((c0[i] == c1[i]) & (c0[j] == c1[j]) & (c0[i] == c0[j]))
        i, j = i[keep], j[keep]
        bound = np.minimum(top[i], top[j]).sum(1, dtype=np.int64)
        keep = bound * (num + den) >= num * (low[i] + low[j])
        return i[keep], j[keep]

    def pairs(self, num: int, den: int):
        """Yield arrays (i, j) of points, i < j by place, that may link."""
        frontier = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while frontier:
            level, i, j = frontier.pop()
            for at in range(0, len(i), 4096):
                a, b = self._survive(level, i[at : at + 4096], j[at : at + 4096], num, den)
                if not level:
                    if len(a):
                        yield self.order[a], self.order[b]
                    continue
                step, n = self.steps[level - 1], len(self.levels[level - 1][0])
                x = (a[:, None, None] * step + np.arange(step)[None, :, None]).repeat(step, 2).ravel()
                y = (b[:, None, None] * step + np.arange(step)[None, None, :]).repeat(step, 1).ravel()
                keep = (x < n) & (y < n) & (x <= y if level > 1 else x < y)
                if keep.any():
                    frontier.append((level - 1, x[keep], y[keep]))


def _frequent(docs: DataFrame, sim: Similarity) -> np.ndarray:
    """Shingles that several of the sampled sets hold, sorted by value, with their frequencies: at most FREQUENT of them."""
    n = docs.count()
    part = min(1.0, max(SAMPLE_PART, SAMPLE_LEAST / max(n, 1)))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))

    def run(batches):
        seen = set()
        for b in batches:
            out = [np.zeros(0, np.uint64)]
            for text in b.column(0).to_pylist():
                s = shingles(text, sim.words)
                key = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
                if key not in seen:
                    seen.add(key)
                    out.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["shingle"])

    found = map_arrow(some.select("text"), run, "shingle long").groupBy("shingle").count().where("count >= 3").orderBy(F.desc("count"), "shingle").limit(FREQUENT).toPandas()
    s, f = found["shingle"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64)
    order = np.argsort(s)
    return np.stack([s[order], f[order].astype(np.uint64)])


def _sets(docs: DataFrame, sim: Similarity) -> DataFrame:
    """Written: doc_id, digest (a hash of the text), n, c1 and c2 (128 bits of the set), counts, fine counts, and prefix, the shingles whose cells the set goes into. A set that a task has met before in a row with a doc_id, and a row without one, come without prefix."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, sim))

    def run(batches):
        known, freq = frequent.value
        seen = set()
        for b in batches:
            n, c1, c2, point, fine, prefix = [], [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text, sim.words)
                key = content(s)
                n.append(len(s))
                c1.append(key[0])
                c2.append(key[1])
                if len(s) and doc is not None and key not in seen:
                    seen.add(key)
                    f = np.zeros(len(s), np.uint64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        f = np.where(known[at] == s, freq[at], f)
                    prefix.append(s[np.lexsort((s, f))[: sim.prefix(len(s))]].tobytes())
                else:
                    prefix.append(None)
                point.append(counts(s).tobytes())
                fine.append(fine_counts(s))
            columns = [b.column(0), b.column(2), *(pa.array(x, pa.int64()) for x in (n, c1, c2)), *(pa.array(x, pa.binary()) for x in (point, fine, prefix))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "c1", "c2", "counts", "fine", "prefix"])

    return materialize(map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest long, n long, c1 long, c2 long, counts binary, fine binary, prefix binary"), "sets")


def _shared_cells(sets: DataFrame) -> DataFrame:
    """cell and c1 of the cells that two classes or more share."""

    def spread(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                keys = [np.frombuffer(p, np.int64) for p in b.column(1).to_pylist()]
                if keys:
                    c1 = np.repeat(b.column(0).to_numpy(), [len(k) for k in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(c1)], names=["cell", "c1"])

    def shared(batches):
        # rows come sorted; a row stays if its neighbour before or after has the same cell and another class. The last row waits for the next batch.
        held: tuple | None = None  # cell, c1, whether the row before had the cell
        for b in batches:
            cell, c1 = b.column(0).to_numpy(), b.column(1).to_numpy()
            before = False
            if held:
                cell, c1, before = np.append(held[0], cell), np.append(held[1], c1), held[2]
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (c1[1:] != c1[:-1])
            cell, c1 = cell[new], c1[new]
            if not len(cell):
                continue
            same = np.concatenate([[before], cell[1:] == cell[:-1]])
            keep = same.copy()
            keep[:-1] |= same[1:]
            keep[-1] = False
            held = (cell[-1], c1[-1], bool(same[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(c1[keep])], names=["cell", "c1"])
        if held and held[2]:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], names=["cell", "c1"])

    rows = sets.where("prefix is not null and doc_id is not null").select("c1", "prefix").mapInArrow(spread, "cell long, c1 long")
    return rows.repartition("cell").sortWithinPartitions("cell", "c1").mapInArrow(shared, "cell long, c1 long")


def _bounded(pairs: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """Those of pairs(a, b) of classes that may link by their finer counts."""
    fine = classes.select("node", "n", "fine")
    points = pairs.distinct().join(fine.toDF("a", "n_a", "fine_a"), "a").join(fine.toDF("b", "n_b", "fine_b"), "b").select("a", "b", "n_a", "n_b", "fine_a", "fine_b")

    def run(batches):
        for b in batches:
            m, n = b.column(2).to_numpy(), b.column(3).to_numpy()
            at = np.arange(b.num_rows)
            bounds = fine_bounds([*b.column(4).to_pylist(), *b.column(5).to_pylist()], at, at + b.num_rows)
            mask = pa.array(bounds * (sim.num + sim.den) >= sim.num * (m + n))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return map_arrow(points, run, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """Those of pairs(a, b) of classes whose sets link, written. The texts of these classes are read and cut again."""
    pairs = materialize(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialize(wanted.join(classes.select("node", "doc", "c1", "c2"), "node"), "wanted")
    small = wanted.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if small else wanted, F.col("doc_id") == F.col("doc")).select("node", "c1", "c2", "text")

    def cut(batches):
        for b in batches:
            node, out = [], []
            for k, c1, c2, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingles(text, sim.words)
                if content(s) == (c1, c2):  # rows that share a doc_id may hold other sets
                    node.append(k)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], names=["node", "set"])

    sets = materialize(map_arrow(texts, cut, "node long, set binary"), "verify")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append(sim.den * common >= sim.num * (len(merged) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    links = materialize(map_arrow(both, check, "a long, b long").distinct(), "links")
    release(pairs, wanted, sets)
    return links


def _dealt(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Written: cell, blocks, own (the class's block), is_first (whether it is the cell's first class, by doc), doc, node, n, counts, for each class of a cell.

    Of cells with the same members, by number and 128 bits of hash, one is enough: near copies share most of their cells.
    """
    sizes = members.groupBy("cell").agg(
        F.count("*").alias("members"), F.min(F.struct("doc", "node")).alias("first"), F.expr("bit_xor(xxhash64(node))").alias("h1"), F.expr("bit_xor(xxhash64(node, 7))").alias("h2")
    )
    cells = sizes.groupBy("members", "first", "h1", "h2").agg(F.min("cell").alias("cell"))
    blocks = cells.select("cell", F.col("first.node").alias("first"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rows = members.select("cell", "node").join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return materialize(rows.join(classes.select("node", "doc", "n", "counts"), "node").select("cell", "blocks", "own", (F.col("node") == F.col("first")).alias("is_first"), "doc", "node", "n", "counts"), "cells")


def _points(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(t["counts"].to_pylist()), np.uint8).reshape(-1, GROUPS)


def nearest(points: np.ndarray, n: np.ndarray, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows that may link by their counts: all of the first HUBS rows, and of each row the NEAREST with the greatest bound of similarity."""
    found = [np.zeros((2, 0), np.int64)]
    if len(n) > LEAF:
        found += [np.stack([i, j]) for i, j in CountTree(points, n, np.arange(len(n))).pairs(sim.num, sim.den)]
    else:  # the tree is one leaf
        i, j = np.triu_indices(len(n), 1)
        found.append(np.stack([i, j])[:, (n[i] * sim.den >= n[j] * sim.num) & (n[j] * sim.den >= n[i] * sim.num)])
    x = open_ended(points)
    i, j = np.concatenate(found, 1)
    bound = np.concatenate([np.zeros(0, np.int64), *(np.minimum(x[i[k : k + 8192]], x[j[k : k + 8192]]).sum(1, dtype=np.int64) for k in range(0, len(i), 8192))])
    keep = bound * (sim.num + sim.den) >= sim.num * (n[i] + n[j])
    i, j, bound = i[keep], j[keep], bound[keep]
    i, j, similar = np.minimum(i, j), np.maximum(i, j), bound / (n[i] + n[j])
    take = i < HUBS
    for one, two in ((i, j), (j, i)):
        order = np.lexsort((two, -similar, one))
        first = np.searchsorted(one[order], one[order])
        take[order[np.arange(len(order)) - first < NEAREST]] = True
    return i[take], j[take]


def _near_first(dealt: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) of nearest() in each block of each cell, in the order of doc. The cell's first class goes into every block."""
    blocks = F.when(F.col("is_first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    rows = dealt.select("cell", F.explode(blocks).alias("block"), "doc", "node", "n", "counts")

    def run(batches):
        for t in grouped(batches, 2):
            if t.num_rows < 2:
                continue
            t = t.sort_by([("doc", "ascending"), ("node", "ascending")])
            node, n = t["node"].to_numpy(), t["n"].to_numpy()
            i, j = nearest(_points(t), n, sim)
            i, j = node[i], node[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    return rows.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(run, "a long, b long")


def _tree_pairs(dealt: DataFrame, classes: DataFrame, linked: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) of different components that survive in the trees of the cells, and by their finer counts."""
    labels = dealt.select("cell", "node").join(linked, "node", "left").select("cell", F.coalesce("component", "node").alias("component"))
    still_open = labels.groupBy("cell").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("members >= 3 and low <> high").select("cell")
    rows = dealt.where("not is_first").join(still_open, "cell", "left_semi").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "n", "component", "counts")
    rows = rows.join(classes.select("node", "fine"), "node").select("cell", "x", "y", "own", "node", "n", "component", "counts", "fine")

    def run(batches):
        for t in grouped(batches, 3):
            node, n, component, own = (t[c].to_numpy() for c in ("node", "n", "component", "own"))
            if len(node) < 2 or (component == component[0]).all():
                continue
            fine, apart = t["fine"].to_pylist(), t["x"][0].as_py() != t["y"][0].as_py()
            for i, j in CountTree(_points(t), n, component).pairs(sim.num, sim.den):
                keep = component[i] != component[j]
                if apart:
                    keep &= own[i] != own[j]
                i, j = i[keep], j[keep]
                if len(i):
                    keep = fine_bounds(fine, i, j) * (sim.num + sim.den) >= sim.num * (n[i] + n[j])
                    i, j = node[i[keep]], node[j[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    return rows.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y").mapInArrow(run, "a long, b long")


def jaccard_groups(docs: DataFrame, sim: Similarity = Similarity(4, 85, 100)) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_shingles, component_id, the smallest doc_id that links lead to.

    Besides, digest, the xxhash64 of the text, and component, a number that tells components apart which share their smallest doc_id (null without one).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Texts without a word, empty and null ones have no shingle and no link.
    Rows that share a doc_id are judged each by its own text, and link nothing by sharing it. Rows with a null doc_id have no component and link nothing. An empty table gives an empty result.
    No link between different sets is lost: cells, blocks and trees only drop pairs that can't link, and what is skipped within a component is connected already.
    """
    docs = docs.select("doc_id", "text")
    sets = _sets(docs, sim)
    full = sets.where("n > 0 and doc_id is not null")
    classes = full.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("fine").alias("fine"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so numbers stay
    members = materialize(_shared_cells(sets).join(classes.select("c1", "doc", "node"), "c1").select("cell", "doc", "node"), "members")
    dealt = _dealt(members, classes)
    release(members)
    links = _verified(_bounded(_near_first(dealt, sim), classes, sim), classes, docs, sim)
    linked = components(links)
    more = _verified(_tree_pairs(dealt, classes, linked, sim), classes, docs, sim)
    if not more.isEmpty():
        linked = components(links.union(more))
    release(dealt, links, more)
    owner = full.select("doc_id", "digest", "n", "c1", "c2").join(classes.select("c1", "c2", "node", "doc"), ["c1", "c2"]).join(labelled(linked, classes), "node", "left")
    columns = ("doc_id", F.col("n").alias("n_shingles"))
    joined = owner.select(*columns, F.coalesce("component_id", "doc").alias("component_id"), "digest", F.coalesce("component", "node").alias("component"))
    return joined.unionByName(sets.where("n = 0 or doc_id is null").select(*columns, F.col("doc_id").alias("component_id"), "digest", F.lit(None).cast("long").alias("component")))


#: The letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
held AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM held x JOIN held y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sets x ON a = x.doc_id JOIN sets y ON b = y.doc_id
  WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(b) AS component_id FROM sets JOIN reach ON doc_id = a GROUP BY doc_id
"""
