"""Removal of byte passages that an earlier document has, by suffix arrays built block by block with a difference cover.

What is compared are windows of LEAST bytes. Three steps keep sorting within bounds:

1. Strands. A window's key is the least hash of the GRAM-byte strings inside it; a strand is a run of windows with one key. Equal windows have equal keys, so only strands
   whose key several documents hold can matter. Documents lie in chunks (a bucketed table that never moves). A chunk sends each shard of the keys its own, packed; the shard answers with those that
   occur elsewhere.
2. Buckets. A chunk sends each such strand once, with the smallest document that has it, to the bucket of its key. Strands of a key with very many go window by window
   to buckets by the window's content, so no key meets in one task.
3. Suffix arrays. A bucket's strands are taken in blocks. In a block the suffixes of a difference cover modulo PERIOD are ranked by doubling; then one range of suffixes at a time is sorted by
   its first PERIOD bytes, and what ties is put in order by the ranks of the cover's next suffixes, which two suffixes always reach together. Neighbours that share
   LEAST bytes are one window, and its smallest document is known.

A bucket answers each chunk with the windows of its strands that a smaller document has. The chunk marks them, and every window of a strand in all but the smallest of its own documents that have it.

Chunks, shards and buckets are of a fixed size, so a chunk's message to a shard holds fewer keys the larger the input is, about 800,000 times SHARD over all bytes; beyond some ten terabytes CHUNK and SHARD
should grow with the executors' memory, or messages come down to single keys, as in a plain shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.lineage import shared_folder

from .common import BATCH_ROWS, materialize, release

#: Bytes of a window, and of the strings whose least hash is its key.
LEAST, GRAM = 50, 32
#: Windows of a strand at most; bytes of a chunk, about; bytes of documents for each shard of keys and for each bucket of strands; bytes hashed at once.
RUN, CHUNK, SHARD, BUCKET, SLAB = 32, 1 << 23, 1 << 24, 1 << 23, 1 << 20
#: Strands of a key above which it is dealt out by window; bytes of a block of strands; suffixes sorted at once.
HOT, BLOCK, SORTED = 4096, 1 << 20, 1 << 15
#: The period of the difference cover and the cover: any two residues are, by some step below the period, both in it.
PERIOD, COVER = 7, (0, 1, 3)
STEP = np.array([[next(s for s in range(PERIOD) if (a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])

_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)
_ODD = 0x9E3779B97F4A7C15


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes (48 bits) of the GRAM-byte strings of data."""
    h, power, size = _BYTES[data], _ODD, 1
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), 2 * size
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(16)


def keys(data: np.ndarray) -> np.ndarray:
    """The key of each window of data."""
    h, span, width = grams(data), LEAST - GRAM + 1, 1
    while 2 * width <= span:
        h, width = np.minimum(h[:-width], h[width:]), 2 * width
    return np.minimum(h[: len(h) - (span - width)], h[span - width :])


def strands(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and key of each strand of documents that lie end to end in data."""
    found = []
    for at in range(0, max(len(data) - LEAST + 1, 0), SLAB):
        key = keys(data[at : at + SLAB + LEAST - 1])
        n = len(key)
        near = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + n + LEAST, "left")] - at  # documents that end within reach
        new, past = np.ones(n, bool), np.zeros(n + 1, np.int32)
        new[1:] = key[1:] != key[:-1]
        new[near[near < n]] = True
        np.add.at(past, np.clip(near - LEAST + 1, 0, n), 1)  # from here windows would go past the end
        np.add.at(past, np.clip(near, 0, n), -1)
        past = np.cumsum(past[:-1]) > 0
        new[1:] |= past[1:] != past[:-1]
        s = np.flatnonzero(new)
        size = np.diff(np.append(s, n))
        s, size = s[~past[s]], size[~past[s]]
        parts = -(-size // RUN)
        if (parts > 1).any():
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            s, size = np.repeat(s, parts) + step * RUN, np.minimum(np.repeat(size, parts) - step * RUN, RUN)
        found.append((at + s, size, key[s]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Chunk:
    """A chunk's documents end to end, in the order of their rows; rows with a null doc_id have no strands."""

    def __init__(self, t: pa.Table):
        self.table = t = t.sort_by("row")
        self.size = t["n_bytes"].to_numpy()
        self.ends = np.cumsum(self.size)
        self.raw = b"".join(t["data"].to_pylist())
        self.data = np.frombuffer(self.raw, np.uint8)
        ids = t["doc_id"].to_pylist()
        self.order = {d: k for k, d in enumerate(sorted({d for d in ids if d is not None}))}
        self.ids = sorted(self.order)
        self.rank = np.array([self.order.get(d, -1) for d in ids], np.int64)  # equal documents have equal ranks, and smaller ones smaller
        start, n, key = strands(self.data, self.ends)
        doc = self.rank[np.searchsorted(self.ends, start, "right")] if len(start) else start
        some = doc >= 0
        self.start, self.n, self.key, self.doc = start[some], n[some], key[some], doc[some]

    def firsts(self, which: np.ndarray) -> np.ndarray:
        """For each of strands which: the first strand of the smallest document that has its content."""
        order = np.lexsort((self.start[which], self.doc[which]))
        which, found, raw = which[order], {}, self.raw
        spans = zip(which.tolist(), self.start[which].tolist(), (self.start + self.n)[which].tolist(), strict=True)
        lead = np.empty(len(which), np.int64)
        lead[order] = [found.setdefault(raw[s : e + LEAST - 1], k) for k, s, e in spans]
        return lead


def _pack(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, equal bytes together, compressed."""
    return zlib.compress(np.diff(x.astype(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _slim(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(x.astype(kind).tobytes(), 1)


def _wide(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind).astype(np.int64)


def _cuts(x: np.ndarray) -> list[int]:
    """Borders of the runs of equal values."""
    return [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else [0]


def _chunk_table(docs: DataFrame) -> str:
    """Name of a table bucketed by chunk: chunk, row (a row's place in its chunk), doc_id, data (the text's bytes), n_bytes."""
    spark = docs.sparkSession

    def run(batches):
        seen = rows = 0
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                chunk, size = [], b.column(2).to_pylist()
                for task, n in zip(b.column(0).to_pylist(), size, strict=True):
                    chunk.append(task << 32 | seen // CHUNK)
                    seen += n
                place = list(range(rows, rows + b.num_rows))
                rows += b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(place, pa.int64()), b.column(1), b.column(3), b.column(2)], names=["chunk", "row", "doc_id", "data", "n_bytes"])

    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.spark_partition_id().cast("long"), "doc_id", F.octet_length(data).cast("long"), data)
    name = f"factloom_texts_{uuid.uuid4().hex}"
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = rows.mapInArrow(run, f"chunk long, row long, doc_id {kind}, data binary, n_bytes long")
    out.write.bucketBy(buckets, "chunk").option("path", f"{shared_folder(spark)}/factloom/{name}").saveAsTable(name)
    return name


def messages(table: DataFrame, shards: int) -> DataFrame:
    """What each chunk sends each shard of keys: its keys, how many strands each has, and whether several of its documents hold it."""

    def run(t: pa.Table) -> pa.Table:
        c = Chunk(t)
        order = np.lexsort((c.doc, c.key, c.key % np.uint64(shards)))
        key, doc = c.key[order], c.doc[order]
        cut = np.array(_cuts(key)[:-1], np.int64) if len(key) else np.zeros(0, np.int64)
        last = np.append(cut, len(key))[1:] - 1
        key, n, again = key[cut], np.diff(np.append(cut, len(key))), doc[cut] != doc[last]
        shard = (key % np.uint64(shards)).astype(np.int64)
        rows, edges = [], _cuts(shard)
        for a, b in zip(edges, edges[1:], strict=False):
            rows.append((int(shard[a]), _pack(key[a:b]), _slim(np.minimum(n[a:b], 0xFFFF), "<u2"), _slim(again[a:b], "<u1")))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([t["chunk"][0].as_py()] * len(rows), pa.int64()), *(pa.array(x, k) for x, k in zip(columns, types, strict=True))], names=["chunk", "shard", "keys", "n", "again"])

    return table.groupBy("chunk").applyInArrow(run, "chunk long, shard long, keys binary, n binary, again binary")


def replies(sent: DataFrame, hot: int) -> DataFrame:
    """What each shard answers each chunk: those of its keys that several documents hold, and into how many buckets each is dealt (0: into that of the key)."""

    def run(t: pa.Table) -> pa.Table:
        found = [_unpack(x.as_py()) for x in t["keys"]]
        key, n, again = np.concatenate(found), np.concatenate([_wide(x.as_py(), "<u2") for x in t["n"]]), np.concatenate([_wide(x.as_py(), "<u1") for x in t["again"]])
        distinct, of = np.unique(key, return_inverse=True)
        chunks, total = np.bincount(of), np.bincount(of, n)
        live = ((chunks > 1) | (np.bincount(of, again) > 0))[of]
        parts = np.where(total > hot, np.minimum(np.ceil(total / hot), 0xFFFF), 0).astype(np.int64)[of]
        at, rows = 0, []
        for c, x in zip(t["chunk"].to_pylist(), found, strict=True):
            own = live[at : at + len(x)]
            if own.any():
                rows.append((c, _pack(x[own]), _slim(parts[at : at + len(x)][own], "<u2")))
            at += len(x)
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "keys", "parts"])

    return sent.groupBy("shard").applyInArrow(run, "chunk long, keys binary, parts binary")


def strands_sent(table: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """What each chunk sends each bucket: its distinct live strands (hot keys: their windows), with key and smallest document. at is where the strand starts in the chunk, window which of its windows this is (-1: all)."""
    kind = table.schema["doc_id"].dataType.simpleString()
    ids = pa.schema([pa.field("d", table.select("doc_id").limit(0).toArrow().schema.field(0).type)]).field(0).type

    def run(t: pa.Table, answer: pa.Table) -> pa.Table:
        out, chunk = [], t["chunk"][0].as_py() if t.num_rows else None
        if t.num_rows and answer.num_rows:
            c = Chunk(t)
            live, parts = np.concatenate([_unpack(x.as_py()) for x in answer["keys"]]), np.concatenate([_wide(x.as_py(), "<u2") for x in answer["parts"]])
            order = np.argsort(live)
            live, parts = live[order], parts[order]
            at = np.minimum(np.searchsorted(live, c.key), len(live) - 1)
            which = np.unique(c.firsts(np.flatnonzero(live[at] == c.key)))
            split = parts[at[which]]
            cold, hot = which[split == 0], which[split > 0]
            n = c.n[hot]
            w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # hot strands go window by window
            single = np.repeat(c.start[hot], n) + w
            lots = 1 + np.array([zlib.crc32(c.raw[s : s + LEAST]) for s in single.tolist()], np.int64) % np.repeat(split[split > 0], n)
            strand = np.concatenate([cold, np.repeat(hot, n)])
            begin, size = np.concatenate([c.start[cold], single]), np.concatenate([c.n[cold] + LEAST - 1, np.full(len(w), LEAST)])
            lot, window = np.concatenate([np.zeros(len(cold), np.int64), lots]), np.concatenate([np.full(len(cold), -1), w])
            bucket = ((c.key[strand] + lot.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((lot, c.key[strand], bucket))
            cuts = _cuts(bucket[order])
            for s, e in zip(cuts, cuts[1:], strict=False):
                o = order[s:e]
                content = zlib.compress(b"".join([c.raw[x : x + y] for x, y in zip(begin[o].tolist(), size[o].tolist(), strict=True)]), 1)
                numbers = (_slim(lot[o], "<u2"), _slim(size[o], "<u1"), _slim(c.start[strand[o]], "<i8"), _slim(window[o], "<i2"))
                out.append((int(bucket[o[0]]), _pack(c.key[strand[o]]), *numbers, content, [c.ids[d] for d in c.doc[strand[o]].tolist()]))
        columns = list(zip(*out, strict=True)) or [[]] * 8
        types = (pa.int64(), *[pa.binary()] * 6, pa.list_(ids))
        return pa.table([pa.array([chunk] * len(out), pa.int64()), *(pa.array(x, y) for x, y in zip(columns, types, strict=True))], names=["chunk", "bucket", "keys", "lots", "lengths", "at", "window", "content", "docs"])

    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, f"chunk long, bucket long, keys binary, lots binary, lengths binary, at binary, window binary, content binary, docs array<{kind}>")


def cover_ranks(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """At each place of text that belongs to the cover, the rank of its suffix by the first LEAST bytes or more; 0 elsewhere and past the end. words: the first PERIOD bytes at each place, as numbers."""
    at = np.flatnonzero(np.isin(np.arange(len(words)) % PERIOD, COVER))
    rank = np.zeros(len(words) + PERIOD * 16, np.int64)
    _, of = np.unique(words[at], return_inverse=True)
    rank[at], size = of + 1, PERIOD
    while size < LEAST:
        _, of = np.unique(rank[at] * (len(at) + 2) + rank[at + size], return_inverse=True)
        rank[at], size = of + 1, 2 * size
    return rank


def words_of(text: np.ndarray) -> np.ndarray:
    """The first PERIOD bytes at each place of text (0 past its end), as numbers in the order of the bytes."""
    padded = np.concatenate([text, np.zeros(PERIOD, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(PERIOD):
        out = out << np.uint64(8) | padded[k : k + len(text)]
    return out


def ordered(place: np.ndarray, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """place, some places of a text, in the order of their suffixes: by their first PERIOD bytes, then by the ranks that the cover has for them."""
    kind = place % PERIOD
    word = words[place]
    by = np.lexsort((rank[place + STEP[kind, kind]], kind, word))  # right where all that tie lie alike to the cover
    place, kind, word = place[by], kind[by], word[by]
    new = np.append(True, word[1:] != word[:-1])
    tie = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    mixed = np.maximum.reduceat(kind, start) != np.minimum.reduceat(kind, start) if len(start) else np.zeros(0, bool)
    at = np.flatnonzero(mixed[tie]) if len(start) else start
    if len(at):
        own, kinds, base = place[at], kind[at], tie[at] * (len(rank) + 1)
        less = np.zeros(len(at), np.int64)
        members = [np.flatnonzero(kinds == k) for k in range(PERIOD)]
        for a in range(PERIOD):
            for b in range(PERIOD):  # how many of kind b come before each of kind a in its tie, seen from where both meet the cover
                i, j, step = members[a], members[b], STEP[a, b]
                there = np.sort(base[j] + rank[own[j] + step])
                less[i] += np.searchsorted(there, base[i] + rank[own[i] + step]) - np.searchsorted(there, base[i])
        place[at] = own[np.lexsort((less, base))]
    return place


def meetings(contents: list[bytes]) -> np.ndarray:
    """Where in each strand the string lies that gives its key: in equal windows of other strands it is the same string."""
    size = np.array([len(c) for c in contents])
    start, n = np.cumsum(size) - size, size - GRAM + 1
    h = grams(np.frombuffer(b"".join(contents), np.uint8))
    base = np.repeat(np.cumsum(n) - n, n)
    h = h[np.repeat(start, n) + np.arange(n.sum()) - base]
    first = np.cumsum(n) - n
    at = np.flatnonzero(h == np.repeat(np.minimum.reduceat(h, first), n))
    return at[np.searchsorted(at, first)] - first


def least_docs(contents: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each of contents, in order: the smallest of docs of any content that has it. And how many windows each has.

    Strands are laid out so that the strings that give their keys lie alike to the cover; so most windows that tie do.
    """
    parts, starts, at = [], [], 0
    for c, s in zip(contents, meetings(contents).tolist(), strict=True):
        gap = -(at + s) % PERIOD
        parts.append(b"\0" * gap + c)
        starts.append(at + gap)
        at += gap + len(c)
    text = np.frombuffer(b"".join(parts) + b"\0" * LEAST, np.uint8)
    words = words_of(text)
    rank = cover_ranks(text, words)
    n = np.array([len(c) - LEAST + 1 for c in contents])
    base = np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(np.array(starts), n) + np.arange(n.sum()) - base
    doc = np.repeat(docs, n)
    best, home = np.zeros(len(place), np.int64), np.zeros(len(text), np.int64)
    home[place] = np.arange(len(place))
    # borders of ranges of suffixes, so that one range at a time is sorted; equal words stay together
    borders = np.unique(np.sort(words[place])[::SORTED])
    which = np.searchsorted(borders, words[place], "right")
    offsets = [*range(0, LEAST - PERIOD, PERIOD), LEAST - PERIOD]
    for g in range(1, len(borders) + 1):
        sa = ordered(place[which == g], words, rank)
        new = np.ones(len(sa), bool)
        new[1:] = np.any([words[sa[1:] + o] != words[sa[:-1] + o] for o in offsets], axis=0)
        group = np.flatnonzero(new)
        own = home[sa]
        best[own] = np.repeat(np.minimum.reduceat(doc[own], group), np.diff(np.append(group, len(sa))))
    return best, n


def shared_windows(sent: DataFrame) -> DataFrame:
    """What each bucket answers each chunk: places of its strands, and as bits the windows that a smaller document has."""

    def run(t: pa.Table) -> pa.Table:
        key, lot, length, at, window = (np.concatenate([f(x.as_py()) for x in t[c]]) for c, f in (
            ("keys", lambda x: _unpack(x).astype(np.int64)), ("lots", lambda x: _wide(x, "<u2")), ("lengths", lambda x: _wide(x, "<u1")), ("at", lambda x: _wide(x, "<i8")), ("window", lambda x: _wide(x, "<i2"))))
        chunk = np.repeat(t["chunk"].to_numpy(), [len(x) for x in t["docs"]])
        ids = [d for x in t["docs"].to_pylist() for d in x]
        rank = {d: k for k, d in enumerate(sorted(set(ids)))}
        doc = np.array([rank[d] for d in ids], np.int64)
        ends = np.cumsum(length)
        data = b"".join(zlib.decompress(x.as_py()) for x in t["content"])
        contents = [data[e - n : e] for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
        masks = np.zeros(len(doc), np.uint64)
        known: dict[bytes, int] = {}
        code = np.array([known.setdefault(x, len(known)) for x in contents], np.int64)
        order = np.lexsort((code, lot, key))
        edges = np.array(_cuts(key[order] * 65537 + lot[order]), np.int64)
        first, last = edges[:-1], edges[1:] - 1
        one = code[order[first]] == code[order[last]]
        # a key with one text: all its windows have the same documents
        least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(edges))
        beyond = order[np.repeat(one, np.diff(edges)) & (doc[order] > least)]
        masks[beyond] = (np.uint64(1) << (length[beyond] - LEAST + 1).astype(np.uint64)) - np.uint64(1) << np.maximum(window[beyond], 0).astype(np.uint64)
        # others in blocks of whole keys
        groups = np.flatnonzero(~one)
        size = np.cumsum([int(length[order[s:e]].sum()) for s, e in zip(edges[groups].tolist(), edges[groups + 1].tolist(), strict=True)])
        cuts = _cuts(np.append(0, size[:-1]) // BLOCK) if len(groups) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows = np.concatenate([order[s:e] for s, e in zip(edges[groups[a:b]].tolist(), edges[groups[a:b] + 1].tolist(), strict=True)])
            distinct, at_, of = np.unique(code[rows], return_index=True, return_inverse=True)
            lowest = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(lowest, of, doc[rows])
            best, n = least_docs([contents[r] for r in rows[at_].tolist()], lowest)
            n_row, base = n[of], (np.cumsum(n) - n)[of]
            start = np.cumsum(n_row) - n_row
            w = np.arange(n_row.sum()) - np.repeat(start, n_row)
            low = best[np.repeat(base, n_row) + w] < np.repeat(doc[rows], n_row)
            bits = low.astype(np.uint64) << (w + np.repeat(np.maximum(window[rows], 0), n_row)).astype(np.uint64)
            masks[rows] = np.bitwise_or.reduceat(bits, start)
        hit = np.flatnonzero(masks)
        by = hit[np.argsort(chunk[hit], kind="stable")]
        cuts = _cuts(chunk[by])
        rows = [(int(chunk[by[s]]), _slim(at[by[s:e]], "<i8"), _slim(masks[by[s:e]], "<u8")) for s, e in zip(cuts, cuts[1:], strict=False)]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "at", "masks"])

    return sent.groupBy("bucket").applyInArrow(run, "chunk long, at binary, masks binary")


def removed(c: Chunk, at: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which bytes of a chunk go: those in windows that a smaller document has."""
    hit = np.zeros(len(c.data) + 1, np.int8)
    order = np.argsort(c.key, kind="stable")
    cuts = np.array(_cuts(c.key[order]), np.int64)
    several = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
    mask_at = dict(zip(at.tolist(), [0] * len(at), strict=True))
    for a, m in zip(at.tolist(), masks.tolist(), strict=True):
        mask_at[a] |= m
    which = np.zeros(len(c.key), bool)
    which[order[several]] = True
    which |= np.isin(c.start, at)
    which = np.flatnonzero(which)
    lead = c.firsts(which)
    whole = c.doc[lead] < c.doc[which]
    spans = np.zeros(len(c.data) + 1, np.int32)
    np.add.at(spans, c.start[which[whole]], 1)
    np.add.at(spans, (c.start + c.n)[which[whole]], -1)
    hit[:-1] = np.cumsum(spans[:-1], dtype=np.int32) > 0
    some = which[~whole]
    for s, m in zip(c.start[some].tolist(), [mask_at.get(x, 0) for x in c.start[lead[~whole]].tolist()], strict=True):
        while m:
            low = m & -m
            hit[s + low.bit_length() - 1] = 1
            m ^= low
    covered = np.cumsum(hit[:-1], dtype=np.int32)
    covered[LEAST:] -= covered[:-LEAST].copy()
    return covered > 0


def drop_repeated_passages(docs: DataFrame, hot: int = HOT, buckets: int | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that stay.

    A text is taken as UTF-8, null as empty. A byte goes if a string of LEAST bytes that covers it also starts in a document with a smaller doc_id; overlaps count, and strings are judged
    on the input. Documents shorter than LEAST bytes lose nothing. Rows that share a doc_id are one document: they take nothing from each other. Rows with a null doc_id count as no document and
    lose nothing. An empty table gives an empty result; other columns are ignored. Nothing is cut: long texts go in as they are, and make their chunk as long.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    name = _chunk_table(docs.select("doc_id", "text"))
    table = spark.table(name)
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    shards, n = max(1, -(-total // SHARD)), buckets or max(1, -(-total // BUCKET))
    answers = replies(messages(table, shards), hot)
    marks = shared_windows(strands_sent(table, answers, n))

    def run(t: pa.Table, mark: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([t["doc_id"].slice(0, 0), *(pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
        c = Chunk(t)
        at = np.concatenate([np.zeros(0, np.int64), *(_wide(x.as_py(), "<i8") for x in mark["at"])])
        masks = np.concatenate([np.zeros(0, np.int64), *(_wide(x.as_py(), "<u8") for x in mark["masks"])])
        gone = removed(c, at, masks)
        n_removed, n_spans, kept = [], [], []
        for e, n in zip(c.ends.tolist(), c.size.tolist(), strict=True):
            g, d = gone[e - n : e], c.data[e - n : e]
            n_removed.append(int(g.sum()))
            n_spans.append(int((g[1:] & ~g[:-1]).sum() + g[:1].sum()))
            kept.append(d[~g].tobytes() if n_removed[-1] else d.tobytes())
        return pa.table([c.table["doc_id"], c.table["n_bytes"], pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = table.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    out._texts = name  # for forget()
    return out


def forget(out: DataFrame) -> None:
    """Delete the texts that a result of drop_repeated_passages() reads, when it has been read."""
    out.sparkSession.sql(f"DROP TABLE {out._texts}")
    release(f"{shared_folder(out.sparkSession)}/factloom/{out._texts}", spark=out.sparkSession)


def passage_digest(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = drop_repeated_passages(docs)
    out = materialize(found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "passages")
    forget(found)
    return out


ORACLE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT r, doc_id, unnest(range(length(x) // 2 - 49)) AS s, x FROM docs WHERE length(x) >= 100 AND doc_id IS NOT NULL),
grams AS (SELECT r, doc_id, s, substr(x, 2 * s + 1, 100) AS g FROM windows),
firsts AS (SELECT g, min(doc_id) AS least FROM grams GROUP BY g HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT r, s FROM grams JOIN firsts USING (g) WHERE least < doc_id),
runs AS (SELECT r, min(s) AS s, max(s) + 50 AS e FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS run FROM (
  SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM hits)) GROUP BY r, run),
pieces AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM runs),
kept AS (SELECT d.r, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS k, sum(e - s) AS n_removed, count(*) AS n_spans FROM docs d JOIN pieces p ON d.r = p.r GROUP BY d.r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.r = docs.r
"""
