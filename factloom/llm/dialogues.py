"""The prefix trie of conversations, by polynomial rolling fingerprints of their prefixes.

A turn is known by the SHA-256 of its role and text, so texts are read once and never move. Turns are sorted by ranges; each range is scanned with numpy, and what a
conversation that began in an earlier range brings along (its head, its fingerprint so far) is folded from one summary for each range. A prefix's fingerprint is the sum of its turns'
values, each times a power of a base, so the fingerprints of a conversation that starts with another's turns follow from those of its own.

Prefixes of one depth and fingerprint are a candidate group. All its members must agree in the turn that ends them and in the parent's group; where they don't, the group is split, and all that lies
below it by the same choice, so nodes are exact whatever collides. Everything else is sums over the rows (conversation, depth), partly aggregated before they move:

- a conversation owns the nodes in which it has the smallest number; they are the deep end of its path, from some depth on;
- the leaves below a node are the owners of leaves among its members;
- the sum of (members - 1) * bytes below a node is, for each member, the bytes from the node down to where its own nodes begin.

So no job runs for each level. Only a node's parent is met by its key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import lineage

from .common import map_arrow, materialize

#: The modulus of fingerprints, and the bases of the two that make up 62 bits.
PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)
#: Turns taken over from the first conversation of a group of GROUP are fewer than HEAD.
GROUP, HEAD = 5, 9


def _power(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n modulo PRIME; negative exponents are inverses."""
    n = np.mod(np.asarray(n, np.int64), PRIME - 1)
    out, b = np.ones(n.shape, np.int64), base
    while (n > 0).any():
        out = np.where(n & 1, out * b % PRIME, out)
        b, n = b * b % PRIME, n >> 1
    return out


def _shift(start: tuple, n: int, local: tuple) -> tuple:
    """The prefix (fingerprints, bytes) of n turns start, continued by the turns of local."""
    return (*((a + pow(base, n, PRIME) * b) % PRIME for a, b, base in zip(start, local, BASES, strict=False)), start[2] + local[2])


@dataclass
class Walk:
    """Where a scan stands: the group's first conversation's prefixes, the conversation, its turns so far, their prefix, and its first prefixes."""

    base: object = None
    heads: list[tuple] = field(default_factory=lambda: [(0, 0, 0)])
    conv: object = None
    n: int = 0
    last: tuple = (0, 0, 0)
    own: list[tuple] = field(default_factory=lambda: [(0, 0, 0)])

    def enter(self, base, conv) -> bool:
        """Go to a conversation; whether it is another one."""
        if self.conv == conv:
            return False
        if self.base != base:
            self.base, self.heads = base, [(0, 0, 0)]
        self.conv, self.n, self.last, self.own = conv, 0, (0, 0, 0), [(0, 0, 0)]
        return True

    def extend(self, terms: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefixes after each of the next turns: fingerprints (turn, 2) and bytes."""
        at = self.n + np.arange(len(size))
        f = np.stack([(self.last[k] + np.cumsum(terms[:, k] * _power(b, at) % PRIME)) % PRIME for k, b in enumerate(BASES)], 1)
        y = self.last[2] + np.cumsum(size)
        for k in range(min(len(y), HEAD - len(self.own))):
            self.own.append((int(f[k, 0]), int(f[k, 1]), int(y[k])))
        if self.conv == self.base:
            self.heads = self.own
        self.n, self.last = self.n + len(y), (int(f[-1, 0]), int(f[-1, 1]), int(y[-1]))
        return f, y

    def after(self, later: Walk) -> Walk:
        """This walk, then one that began without knowing of it."""
        same_base, same_conv = self.base == later.base, self.conv == later.conv
        join = lambda first, n, rest: (first + [_shift(first[-1], n, x) for x in rest[1:]])[:HEAD] if n < HEAD - 1 else first
        own = join(self.own, self.n, later.own) if same_conv else later.own
        heads = later.heads
        if same_base and self.conv == self.base:  # the first conversation may go on in the later part
            heads = join(self.heads, self.n, later.heads)
        elif same_base:
            heads = self.heads
        n, last = (self.n + later.n, _shift(self.last, self.n, later.last)) if same_conv else (later.n, later.last)
        return Walk(later.base, heads, later.conv, n, last, own)


def _runs(b: pa.RecordBatch) -> Iterator[tuple]:
    """base, conversation, h, and the slice of its rows, for each run of rows of one conversation."""
    conv = b.column(1).to_numpy()
    edges = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), len(conv)]
    bases, h = b.column(0).to_numpy(), b.column(2).to_numpy()
    for s, e in zip(edges, edges[1:], strict=False):
        yield int(bases[s]), int(conv[s]), int(h[s]), s, e


def _turns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests as four longs, the terms of fingerprints, and bytes, of each row."""
    digests = np.frombuffer(b"".join(b.column(3).to_pylist()), "<i8").reshape(-1, 4)
    return digests, (digests[:, :2].view(np.uint64) % np.uint64(PRIME - 1)).astype(np.int64) + 1, b.column(4).to_numpy().astype(np.int64)


ROWS = "conv_id long, depth long, fp long, pfp long, s0 long, s1 long, s2 long, s3 long, size long, upto long"


def rebuilt_prefixes(conversations: DataFrame, bits: int = 62) -> DataFrame:
    """Written: a row for each prefix of each rebuilt conversation, the empty one included.

    conv_id, depth, fp and pfp (fingerprints of the prefix and of the one before), s0 to s3 (the last turn's digest), size (bytes of its text), upto (bytes of all). Digests are 0 for
    the empty prefix and for turns taken over from the first conversation of the group, whose own row has them. bits: how much of a fingerprint is used (less makes collisions, for tests).
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    h = F.when(F.col("conv_id") == base, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD)
    rows = conversations.where("conv_id is not null").select(base.alias("base"), F.col("conv_id").cast("long").alias("conv_id"), h.cast("long").alias("h"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"), "turn")
    first = (F.col("conv_id") != F.col("base")).alias("later")
    # ranges hold only as long as rows don't move, so they are kept as partitions
    kept = lineage.cut(rows.withColumn("later", first).repartitionByRange("base", "later", "conv_id", "turn").sortWithinPartitions("base", "later", "conv_id", "turn", "digest").select("base", "conv_id", "h", "digest", "size", F.spark_partition_id().cast("long").alias("part")))

    def summary(batches):
        walk, part = Walk(), None
        for b in batches:
            if b.num_rows:
                part = b.column(5)[0].as_py()
                _, terms, size = _turns(b)
                for base, conv, _, s, e in _runs(b):
                    walk.enter(base, conv)
                    walk.extend(terms[s:e], size[s:e])
        if part is not None:
            flat = [[x for p in ps for x in p] for ps in (walk.heads, walk.own, [walk.last])]
            yield pa.RecordBatch.from_pylist([{"part": part, "base": walk.base, "conv": walk.conv, "n": walk.n, "heads": flat[0], "own": flat[1], "last": flat[2]}])

    told = map_arrow(kept, summary, "part long, base long, conv long, n long, heads array<long>, own array<long>, last array<long>").orderBy("part").collect()  # one row for each range
    triples = lambda x: [tuple(x[i : i + 3]) for i in range(0, len(x), 3)]
    before, walk = {}, Walk()
    for r in told:
        before[r["part"]] = walk
        walk = walk.after(Walk(r["base"], triples(r["heads"]), r["conv"], r["n"], triples(r["last"])[0], triples(r["own"])))
    low = (1 << bits) - 1

    def scan(batches):
        walk = None
        for b in batches:
            if not b.num_rows:
                continue
            if walk is None:
                start = before[b.column(5)[0].as_py()]
                walk = Walk(start.base, list(start.heads), start.conv, start.n, start.last, list(start.own))
            digests, terms, size = _turns(b)
            out = []
            for base, conv, h, s, e in _runs(b):
                new = walk.enter(base, conv)
                m = min(h, len(walk.heads) - 1) if conv != base else 0
                if new:
                    heads = np.array([walk.heads[0], *walk.heads[: m + 1]], np.int64)  # one more before the root, for its row
                    f = heads[:, 0] << 31 | heads[:, 1]
                    one = np.zeros((m + 1, 10), np.int64)
                    one[:, 0], one[:, 1], one[:, 2], one[:, 3], one[:, 8], one[:, 9] = conv, np.arange(m + 1), f[1:], f[:-1], np.diff(heads[:, 2]), heads[1:, 2]
                    out.append(one)
                at, prior = walk.n, walk.last
                f, y = walk.extend(terms[s:e], size[s:e])
                skip = min(max(h - at, 0), e - s)  # turns that the head replaces
                if skip < e - s:
                    head, own, f = walk.heads[m], walk.own[h], np.concatenate([[prior[:2]], f])
                    joined = [(head[k] + (f[skip:, k] - own[k]) % PRIME * int(_power(b, np.int64(m - h)))) % PRIME for k, b in enumerate(BASES)]
                    joined = joined[0] << 31 | joined[1]
                    one = np.zeros((e - s - skip, 10), np.int64)
                    one[:, 0], one[:, 1], one[:, 2], one[:, 3] = conv, m + at + np.arange(skip, e - s) - h + 1, joined[1:], joined[:-1]
                    one[:, 4:8], one[:, 8], one[:, 9] = digests[s + skip : e], size[s + skip : e], y[skip:] - own[2] + head[2]
                    out.append(one)
            rows = np.concatenate(out) if out else np.zeros((0, 10), np.int64)
            rows[:, 2:4] &= low
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=[c.split()[0] for c in ROWS.split(", ")])

    return materialize(map_arrow(kept, scan, ROWS), "prefixes")


KEY = ["depth", "fp", "path"]
DIGEST = ["s0", "s1", "s2", "s3"]


def verified(rows: DataFrame) -> DataFrame:
    """rows with path and ppath, which part a candidate group's members that differ in their turns or parents; both are empty where nothing collides.

    Turns taken over have no digest; their group's first conversation stands for them, as its prefix is theirs by construction.
    """
    told = rows.where("s0 <> 0 or s1 <> 0 or s2 <> 0 or s3 <> 0")
    facts = ["pfp", *DIGEST]
    agree = F.lit(True)
    for c in facts:
        agree = agree & (F.col(f"min_{c}") == F.col(f"max_{c}"))
    spans = told.groupBy("depth", "fp").agg(*[f(c).alias(f"{n}_{c}") for c in facts for n, f in (("min", F.min), ("max", F.max))])
    split = materialize(spans.where(~agree).select("depth", "fp"), "split")
    if split.isEmpty():
        return rows.select("*", F.lit("").alias("path"), F.lit("").alias("ppath"))
    variants = told.join(split, ["depth", "fp"]).select("depth", "fp", *facts).distinct()
    variants = variants.withColumn("variant", F.row_number().over(Window.partitionBy("depth", "fp").orderBy(*facts)))
    # every conversation's choices; a taken-over turn is looked up in the conversation that has it
    source = F.when((F.col("s0") == 0) & (F.col("s1") == 0) & (F.col("s2") == 0) & (F.col("s3") == 0), F.col("conv_id") - F.col("conv_id") % GROUP).otherwise(F.col("conv_id"))
    own = told.join(variants, ["depth", "fp", *facts]).select(F.col("conv_id").alias("source"), "depth", "variant")
    chosen = rows.join(split, ["depth", "fp"], "left_semi").withColumn("source", source).join(own, ["source", "depth"]).select("conv_id", "depth", "variant")
    marks = chosen.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "variant"))).alias("marks"))  # as long as a conversation's collisions
    text = lambda most: F.array_join(F.transform(F.filter(F.coalesce("marks", F.expr("cast(array() as array<struct<depth:bigint,variant:int>>)")), lambda m: m["depth"] <= most), lambda m: F.concat_ws(":", m["depth"], m["variant"])), ",")
    return materialize(rows.join(marks, "conv_id", "left").select(*rows.columns, text(F.col("depth")).alias("path"), text(F.col("depth") - 1).alias("ppath")), "verified")


def _ends(ends: DataFrame) -> DataFrame:
    """For each node of ends(KEY, conv_id), which is written: the SHA-256 of its conversations' numbers, ascending, joined by commas.

    Numbers are sorted by ranges and joined there; one task hashes a node's joined parts in order, a batch at a time, as SHA-256 goes through its input in order.
    """

    def blocks(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            conv, rows, s = b.column(3).to_pylist(), [], 0
            for e in range(1, len(keys) + 1):
                if e == len(keys) or keys[e] != keys[s]:
                    rows.append((*keys[s], conv[s], ",".join(map(str, conv[s:e]))))
                    s = e
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names=[*KEY, "first", "text"])

    def run(batches):
        key, state = None, None
        for b in batches:
            done = []
            for d, f, p, _, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (d, f, p) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (d, f, p), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*KEY, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=[*KEY, "ends_sha256"])

    sorted_ends = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    parts = sorted_ends.mapInArrow(blocks, "depth long, fp long, path string, first long, text string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(run, "depth long, fp long, path string, ends_sha256 string")


def conversation_trie(conversations: DataFrame, bits: int = 62) -> DataFrame:
    """The nodes of the trie of conversations(conv_id, turn, role, text), rebuilt: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns are ordered by turn, null first, and of equal turn by the SHA-256 of role and text; null role or text is empty; rows that repeat are turns of their own. It is rebuilt as the
    first h turns of conversation conv_id - conv_id % 5, with h the unsigned CRC-32 of its number in decimal, modulo 9 (all if there are fewer, none if it isn't there), then its own turns after its first h. A node is a distinct
    sequence of the first d rebuilt turns; conv_id is its smallest member. Rows with a null conv_id belong to no conversation. An empty table has no nodes. Other columns are ignored.
    Texts count whole, whatever their length.
    """
    prefixes = rebuilt_prefixes(conversations, bits)
    rows = verified(prefixes)
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("upto").alias("upto"), F.max("size").alias("size"), F.max("pfp").alias("pfp"), F.max("ppath").alias("ppath"))
    nodes = materialize(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pfp").alias("fp"), F.col("ppath").alias("path")).agg(F.count("*").alias("n_children"))
    nodes_of = materialize(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # by conversation: how deep it goes, where its own nodes begin, and whether they end in a leaf
    owned = nodes_of.groupBy("conv_id").agg(F.min("depth").alias("start"), F.min(F.col("upto") - F.col("size")).alias("before"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    convs = rows.groupBy("conv_id").agg(F.max("depth").alias("length"), F.max("upto").alias("total")).join(owned, "conv_id", "left")
    convs = materialize(convs.select("conv_id", "length", F.coalesce("start", F.col("length") + 1).alias("start"), F.coalesce("before", "total").alias("before"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "conversations")
    known = rows.join(convs, "conv_id")
    gap = F.when(F.col("depth") < F.col("start"), F.col("before") - F.col("upto") + F.col("size")).otherwise(0)
    below = known.groupBy(*KEY).agg(F.sum("leaf").cast("long").alias("n_leaves"), F.sum(gap).cast("long").alias("saved_tokens"))
    ends = _ends(materialize(known.where("depth = length").select(*KEY, "conv_id"), "ends"))
    # the parent of all but a conversation's first own node is its own; the others' parents are met by key
    tops = nodes_of.join(owned.select("conv_id", F.col("start").alias("depth")), ["conv_id", "depth"], "left_semi").where("depth > 0").select(*KEY, (F.col("depth") - 1).alias("d"), F.col("pfp").alias("f"), F.col("ppath").alias("p"))
    above = nodes_of.select(F.col("depth").alias("d"), F.col("fp").alias("f"), F.col("path").alias("p"), F.col("conv_id").alias("above"))
    parents = tops.join(above, ["d", "f", "p"]).select(*KEY, "above")
    out = nodes_of.join(below, KEY).join(ends, KEY, "left").join(parents, KEY, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: CRC-32 of a decimal number, bit by bit, as DuckDB has no function for it.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda a, b: "
    "list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"
)
ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS p, sha, size
  FROM (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
  SELECT c.conv_id, t.p AS d, sha, size FROM convs c JOIN turns t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL
  SELECT c.conv_id, (SELECT count(*) FROM turns b WHERE b.conv_id = c.base AND b.p <= c.h) + t.p - c.h, sha, size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h),
prefixes AS (
  SELECT conv_id, d, size, string_agg(sha, '') OVER (PARTITION BY conv_id ORDER BY d) AS node, max(d) OVER (PARTITION BY conv_id) AS len FROM built
  UNION ALL SELECT conv_id, 0, 0, '', coalesce((SELECT max(d) FROM built b WHERE b.conv_id = c.conv_id), 0) FROM convs c),
nodes AS (SELECT node, min(conv_id) AS conv_id, d, count(*) AS n, max(size) AS size, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = d), '') AS ends FROM prefixes GROUP BY node, d),
pairs AS (SELECT a.node AS top, b.* FROM nodes a JOIN nodes b ON starts_with(b.node, a.node)),
inner_nodes AS (SELECT DISTINCT left(node, length(node) - 64) AS node FROM nodes WHERE d > 0),
sums AS (SELECT top, count(*) FILTER (WHERE pairs.d = (SELECT d FROM nodes t WHERE t.node = top) + 1) AS n_children, count(*) FILTER (WHERE i.node IS NULL) AS n_leaves, sum((n - 1) * size) AS saved
  FROM pairs LEFT JOIN inner_nodes i ON i.node = pairs.node GROUP BY top)
SELECT a.conv_id, a.d::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM nodes a JOIN sums s ON s.top = a.node LEFT JOIN nodes p ON a.d > 0 AND p.node = left(a.node, length(a.node) - 64)
"""
