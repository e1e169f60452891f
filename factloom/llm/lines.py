"""Line dedup: two Bloom filters, one of line hashes seen and one of those seen again, keep all but suspected repeats out of the shuffle.

Lines are cut into chunks of a bounded size; a chunk's line digests are written once, bucketed by chunk, and never move. Filters are cut into shards by the hash.
A chunk sends each shard the positions that its lines set once and more than once, compressed; a shard's task joins them (what two chunks both set counts as
seen again) and answers each chunk with those of its positions that were seen again, and with nothing else. So no task, broadcast or driver ever holds more than
a shard's bits or a chunk's lines, whatever the number of lines. Lines with all positions seen again are suspects; only they shuffle, to be counted exactly by
the SHA-256 of their key, with the number of documents and the largest document of each.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.lineage import shared_folder

from .common import fresh, map_arrow, materialize, release

#: What is stripped from a key, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits that the filters have for a line, of a shard at least and at most, shards above which they grow, and lines of a chunk, about.
BITS_PER_LINE, SHARD_BITS, MOST_BITS, SHARDS, CHUNK = 16, 1 << 22, 1 << 26, 4096, 1 << 17
#: Keys of so many documents or more are joined apart, and how many such keys there are at most.
HOT_DOCS, HOT_KEYS = 1024, 10_000


class Filter(NamedTuple):
    """The shape of the filters: shards, a power of two of bits each."""

    shards: int
    bits: int

    @classmethod
    def of(cls, lines: int) -> Filter:
        bits = SHARD_BITS
        while lines * BITS_PER_LINE > SHARDS * bits and bits < MOST_BITS:
            bits *= 2
        return cls(max(1, -(-lines * BITS_PER_LINE // bits)), bits)

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard and two positions of each digest (rows of 32 bytes)."""
        h = np.ascontiguousarray(digests[:, :16]).view("<u8")
        low = np.uint64(self.bits - 1)
        return tuple(x.astype(np.int64) for x in (h[:, 0] % np.uint64(self.shards), h[:, 1] & low, (h[:, 1] >> np.uint64(32)) & low))


def key_digest(line: str) -> bytes:
    """SHA-256 of the key of a line: blanks stripped at both ends, A-Z lower-cased."""
    return hashlib.sha256(line.strip(BLANKS).encode().lower()).digest()


def text_digests(text: str | None, least_chars: int) -> set[bytes]:
    """Digests of the text's keys of enough characters."""
    return {hashlib.sha256(k.encode().lower()).digest() for k in {x.strip(BLANKS) for x in (text or "").split("\n")} if len(k) >= least_chars}


def _line_table(docs: DataFrame, least_chars: int) -> str:
    """Name of a table bucketed by chunk: chunk, doc_id, digests (joined), n (how many)."""
    spark = docs.sparkSession

    def run(batches):
        lines = 0
        for b in batches:
            chunk, out = [], []
            for task, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = text_digests(text, least_chars)
                chunk.append(task << 32 | lines // CHUNK)
                lines += len(found)
                out.append(b"".join(found))
            n = [len(x) // 32 for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), b.column(1), pa.array(out, pa.binary()), pa.array(n, pa.int64())], names=["chunk", "doc_id", "digests", "n"])

    rows = docs.where("doc_id is not null").select(F.spark_partition_id().cast("long"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    name = f"factloom_lines_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/factloom/{name}"
    found = map_arrow(rows, run, f"chunk long, doc_id {kind}, digests binary, n long").where("n > 0")
    found.write.bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    return name


def _pack(positions: np.ndarray) -> bytes:
    return zlib.compress(np.diff(positions, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int64)


def _digests(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["digests"].to_pylist()), np.uint8).reshape(-1, 32)


def messages(lines: DataFrame, shape: Filter) -> DataFrame:
    """What each chunk of lines sends each shard: the positions that its lines set, and those that lines of several of its documents set."""

    def run(t: pa.Table) -> pa.Table:
        digests = _digests(t)
        _, first, counts = np.unique(np.ascontiguousarray(digests).view("V32").ravel(), return_index=True, return_counts=True)
        shard, p, q = shape.places(digests[first])
        order = np.argsort(shard, kind="stable")
        shard, p, q, again = shard[order], p[order], q[order], counts[order] > 1
        edges = [*np.flatnonzero(np.diff(shard, prepend=shard[0] - 1)), len(shard)]
        rows = []
        for a, b in zip(edges, edges[1:], strict=False):
            twice = again[a:b]
            rows.append((int(shard[a]), _pack(np.unique(np.concatenate([p[a:b], q[a:b]]))), _pack(np.unique(np.concatenate([p[a:b][twice], q[a:b][twice]])))))
        shards, once, twice = zip(*rows, strict=True)
        return pa.table({"chunk": pa.array([t["chunk"][0].as_py()] * len(rows), pa.int64()), "shard": pa.array(shards, pa.int64()), "once": pa.array(once, pa.binary()), "twice": pa.array(twice, pa.binary())})

    return lines.groupBy("chunk").applyInArrow(run, "chunk long, shard long, once binary, twice binary")


def replies(sent: DataFrame, shape: Filter) -> DataFrame:
    """What each shard answers each chunk: those of the chunk's positions that were seen again."""

    def run(t: pa.Table) -> pa.Table:
        once, twice = np.zeros(shape.bits, bool), np.zeros(shape.bits, bool)
        for a, b in zip(t["once"], t["twice"], strict=True):
            a = _unpack(a.as_py())
            twice[a[once[a]]] = True
            once[a] = True
            twice[_unpack(b.as_py())] = True
        chunk, hits = [], []
        for c, a in zip(t["chunk"].to_pylist(), t["once"], strict=True):
            a = _unpack(a.as_py())
            if len(a := a[twice[a]]):
                chunk.append(c)
                hits.append(_pack(a))
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "shard": pa.array([t["shard"][0].as_py()] * len(chunk), pa.int64()), "hits": pa.array(hits, pa.binary())})

    return sent.groupBy("shard").applyInArrow(run, "chunk long, shard long, hits binary")


def _suspected(lines: DataFrame, answers: DataFrame, shape: Filter) -> DataFrame:
    """doc_id and digest of the lines whose positions were all seen again."""
    kind = lines.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table, answer: pa.Table) -> pa.Table:
        if not t.num_rows or not answer.num_rows:
            return pa.table({"doc_id": t["doc_id"].slice(0, 0), "digest": pa.array([], pa.binary())})
        digests = _digests(t)
        row = np.repeat(np.arange(t.num_rows), t["n"].to_numpy())
        seen = np.sort(np.concatenate([_unpack(h) + s * shape.bits for s, h in zip(answer["shard"].to_pylist(), answer["hits"].to_pylist(), strict=True)]))
        shard, *places = shape.places(digests)
        hit = np.ones(len(digests), bool)
        for p in places:
            at = shard * shape.bits + p
            hit &= seen[np.minimum(np.searchsorted(seen, at), len(seen) - 1)] == at
        found = [d.tobytes() for d in digests[hit]]
        return pa.table({"doc_id": t["doc_id"].take(pa.array(row[hit])), "digest": pa.array(found, pa.binary())})

    return lines.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, digest binary")


def suspects(docs: DataFrame, least_chars: int) -> DataFrame:
    """Written: doc_id and digest of the keys that may occur in several rows of docs, once for each row. Rows with a null doc_id are left out."""
    spark = docs.sparkSession
    name = _line_table(docs, least_chars)
    try:
        lines = spark.table(name)
        shape = Filter.of(lines.agg(F.sum("n")).first()[0] or 0)
        return materialize(_suspected(lines, replies(messages(lines, shape), shape), shape), "suspects")
    finally:
        spark.sql(f"DROP TABLE {name}")
        release(f"{shared_folder(spark)}/factloom/{name}", spark=spark)


def _drops(found: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Rows of found(doc_id, digest) whose key so many documents hold, without those of the largest of them; and the table it reads.

    Keys of many documents are few: at most HOT_KEYS, as each takes its part of the rows. They are broadcast, so their rows stay where they are; other keys' rows meet.
    """
    pairs = found.groupBy("digest", "doc_id").count()
    spread = materialize(pairs.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least_docs), "spread")
    hot_docs = max(HOT_DOCS, -(-found.count() // HOT_KEYS))
    hot, cold = spread.where(F.col("n") > hot_docs), spread.where(F.col("n") <= hot_docs)
    few = found.join(F.broadcast(hot), "digest").select("doc_id", "digest", "keeper")
    rest = found.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest").select("doc_id", "digest", "keeper")
    return few.union(rest).where("doc_id <> keeper").select("doc_id", "digest"), spread


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> tuple[DataFrame, str, str]:
    """docs(doc_id, text, any others) with text without its repeated lines, and two more columns at the end: the number of lines before, and of those dropped.
    Returned with these two columns' names, which docs doesn't have.

    A line's key has blanks stripped and A-Z lower-cased. A key of at least least_chars characters that at least least_docs documents hold
    stays in the largest of their doc_ids only, there with all its lines. Rows that share a doc_id are one document.
    Rows with a null doc_id count as no document and keep all lines. Null texts count as empty, that is one empty line. An empty table stays empty.
    """
    found = suspects(docs.select("doc_id", "text"), least_chars)
    names = docs.columns
    at_text = names.index("text")
    n_before, n_gone, gone_of, own_drops = (fresh(names, x) for x in ("n_lines", "n_dropped", "of", "drops"))
    dropped, spread = _drops(found, least_docs)
    drops = materialize(dropped.groupBy(F.col("doc_id").alias(gone_of)).agg(F.collect_set("digest").alias(own_drops)), "drops")
    release(found, spread)
    joined = docs.join(drops.hint("shuffle_hash"), docs["doc_id"] == drops[gone_of], "left").select(*[docs[n] for n in names], own_drops)

    def run(batches):
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(b.column(at_text).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if drop:
                    drop = set(drop)
                    lines = [x for x in lines if key_digest(x) not in drop]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append("\n".join(lines))
            columns = [pa.array(texts, pa.string()) if k == at_text else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, n_before, n_gone])

    schema = docs.select(*[F.lit(None).cast("string").alias(n) if n == "text" else docs[n] for n in names], F.lit(0).cast("long").alias(n_before), F.lit(0).cast("long").alias(n_gone)).schema
    return map_arrow(joined, run, schema), n_before, n_gone


def line_digest(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """For each row of docs: doc_id, n_lines, n_dropped, kept_sha256."""
    kept, n_lines, n_dropped = drop_repeated_lines(docs.select("doc_id", "text"), least_chars, least_docs)
    return kept.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
keyed AS (SELECT r, doc_id, line, pos, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UPPER}', '{LOWER}') AS key FROM lines),
spread AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, coalesce(s.keeper <> k.doc_id, false) AS dropped FROM keyed k LEFT JOIN spread s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
