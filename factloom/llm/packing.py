"""Packing token sequences: shortest-pack-first over the histogram of lengths.

A document's ids are cut into pieces of the sequence length and a rest. Only the histogram of piece lengths, bounded by the
sequence length, reaches the driver. There, lengths are placed longest first, each on the shortest packs that still have room,
a whole group of equal packs at once; the result is a list of patterns with their counts. Patterns are joined back by rank:
the k-th piece of a length, in a fixed order, takes the k-th slot of that length.

Ranks need no global sort: a piece carries its chunk (the task that made it, kept in a written table) and its rank within chunk and length;
a window over the counts of chunks gives each chunk's offset.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, materialize

#: Id that ends a document.
END = 1


class Tokenizer:
    """Ids of a byte-level BPE file of the tokenizers library.

    tiktoken computes the same ids from the same vocabulary much faster; texts that hold one of the file's special
    tokens, or any text where the file isn't such a vocabulary, go through the tokenizers library itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_tokenizers: dict[tuple, Tokenizer] = {}


def tokenizer(*files: str | None) -> Tokenizer:
    """Loaded once in a worker."""
    if files not in _tokenizers:
        _tokenizers[files] = Tokenizer(*files)
    return _tokenizers[files]


def cut(docs: DataFrame, files: tuple, room: int = 2048) -> DataFrame:
    """Pieces of each row of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, chunk, place (rank within chunk and length).

    files: arguments of Tokenizer. A null text is empty, so its only id is the end. The table is written: chunk and place hold only as long as rows don't move.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "place"]

    def run(batches):
        t, chunk, seen = tokenizer(*files), TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                out, docs_of = [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = np.append(t.encode(text or ""), np.uint32(END)).astype("<u4")
                    for start in range(0, len(ids), room):
                        n = min(room, len(ids) - start)
                        docs_of.append(doc)
                        out.append((start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), chunk, seen[n]))
                        seen[n] += 1
                numbers = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)]
                yield pa.RecordBatch.from_arrays([pa.array(docs_of, b.schema.field(0).type), *numbers], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{n} long" for n in names[1:]]])), "pieces")


def shortest_pack_first(histogram: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in the order in which they were placed) and how many sequences follow each.

    histogram: how many pieces have each length from 1 to room. The work depends on the number of lengths and patterns, not on the pieces.
    """
    packs: dict[int, list[list]] = {}  # total: [pattern, count]
    totals: list[int] = []

    def put(total: int, pattern: tuple[int, ...], count: int) -> None:
        if total not in packs:
            packs[total] = []
            insort(totals, total)
        packs[total].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 1 <= length <= room:
            raise ValueError(f"a piece of {length} ids doesn't fit {room}")
        while left > 0:
            if not totals or totals[0] + length > room:
                put(length, (length,), left)
                break
            total = totals[0]
            group = packs[total]
            pattern, count = group[-1]
            n = min(count, left)
            if n == count:
                group.pop()
                if not group:
                    del packs[total]
                    totals.pop(0)
            else:
                group[-1][1] -= n
            put(total + length, (*pattern, length), n)
            left -= n
    return [(tuple(p), n) for total in sorted(packs, reverse=True) for p, n in packs[total]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its runs of slots, the sequence of each run's first slot, and the offset in the sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, files: tuple, room: int = 2048) -> DataFrame:
    """Place every id of docs(doc_id, text) in exactly one sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    One row for each piece; a document has one full piece for each room ids and one of the rest. Repeated rows are packed each.
    Null doc_ids are packed too. An empty table gives an empty result. Other columns are ignored.
    """
    pieces = cut(docs, files, room)
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # room rows at most
    table = slots(shortest_pack_first(histogram, room))
    first = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("chunk", "length", F.coalesce(first, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["chunk", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("place")).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                ranks, sequences, offsets = table[int(n)]
                run = np.searchsorted(ranks, rank[rows], side="right") - 1
                sequence[rows] = sequences[run] + rank[rows] - ranks[run]
                offset[rows] = offsets[run]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
