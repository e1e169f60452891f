"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit, a binary n-gram classifier (naive Bayes over hashed character n-grams of the languages
whose bit is 1 against the others) gives a margin. Decoding adds a loss that falls with the signed margin over the bits of each
codeword and takes the nearest; a text whose best two are close is flagged ambiguous.

Training needs the n-gram counts of each language only: one grouped sum over the training rows, of a size that
languages and n-gram buckets fix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Buckets of hashed n-grams.
BUCKETS = 1 << 15
#: Texts of one language that training reads, about: a bounded sample, taken by the hash of doc_id. Bits of a margin's unit of loss.
SAMPLE, SCALE = 3000, 4.0
#: Languages that can be learned at most; their codewords have at least twice as many bits as their logarithm asks for.
LANGUAGES = 4096
#: 3-grams of a long text that are weighed at once.
PART = 1 << 20
#: A text is ambiguous when the best two codewords' shares differ by less.
CLOSE = 0.2


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of bits 0 and 1. Up to 6 languages: every split into two sets, once. Beyond: random ones whose least distance is the largest of 64 draws."""
    if n <= 6:
        splits = range(1, 1 << max(n - 1, 0))
        return np.array([[s >> k & 1 for s in splits] for k in range(n)], np.int8).reshape(n, -1)
    bits, rng, best, far = int(4 * np.ceil(np.log2(n))) + 8, np.random.default_rng(seed), None, -1
    for _ in range(64 if n <= 256 else 1):
        m = rng.integers(0, 2, (n, bits), dtype=np.int8)
        m[:, (m.sum(0) == 0) | (m.sum(0) == n)] ^= np.eye(n, 1, dtype=np.int8)
        d = m.astype(int) @ (1 - m.T) + (1 - m.astype(int)) @ m.T
        least = int((d + np.eye(n, dtype=int) * bits).min())
        if least > far:
            best, far = m, least
    return best


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[ord("\n")] = ord(" ")


def gram_buckets(data: bytes) -> np.ndarray:
    """Buckets of the byte 3-grams of a text, letters A-Z lower-cased, between two spaces."""
    return _buckets(b" " + data + b" ")


def _buckets(data: bytes) -> np.ndarray:
    b = _FOLD[np.frombuffer(data, np.uint8)]
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(17)


def remainder(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def language_counts(train: DataFrame) -> DataFrame:
    """lang, bucket and n of the n-grams of train(text, lang)."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(gram_buckets(text.encode()), minlength=BUCKETS)
        for lang, n in sums.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(n[k], pa.int64())], names=["lang", "bucket", "n"])

    return train.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(train: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their codewords, and weights (bucket, bit) and offsets: the log odds of a bit for an n-gram."""
    train = train.where("text is not null and lang is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 0), np.int8), np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rows = language_counts(train.where(lot < share[F.col("lang")])).toPandas()  # languages times BUCKETS at most
    counts = np.zeros((len(langs), BUCKETS))
    counts[rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"].to_numpy()
    p = counts + 0.5
    p /= p.sum(1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        one, two = p[code[:, bit] == 1].mean(0), p[code[:, bit] == 0].mean(0)
        weights[:, bit] = np.log(one) - np.log(two)
    return langs, code, weights


def decode(margins: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Share of each language (row: text) from margins a gram (text, bit): the loss log(1 + exp(-SCALE * signed margin)), summed over bits and weighted by how sure a bit is."""
    signs = 2.0 * code - 1.0
    signed = SCALE * margins[:, None, :] * signs[None]
    weight = 0.5 + np.minimum(np.abs(margins), 1.0)[:, None, :]
    loss = (np.logaddexp(0, -signed) * weight).sum(2)
    share = np.exp(-(loss - loss.min(1, keepdims=True)))
    return share / share.sum(1, keepdims=True)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_column: str = "doc_id") -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, lang_pred, score (the share of the best language, 0 to 1), ambiguous.

    A null text, one without a letter, and any text where no language was learned are `und` with score 0. Repeated rows stay repeated. An empty table gives an empty result.
    Only the text counts. Nothing is shuffled.
    """
    langs, code, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            known = [k for k, t in enumerate(texts) if t and langs and any(map(str.isalpha, t))]
            pred, score, close = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known:
                margins = np.empty((len(known), w.shape[1]))
                for row, k in enumerate(known):
                    total, data = np.zeros(w.shape[1]), b" " + texts[k].encode() + b" "
                    for at in range(0, len(data) - 2, PART):  # long texts in parts that share two bytes
                        total += w[_buckets(data[at : at + PART + 2])].sum(0, dtype=np.float64)
                    margins[row] = total / len(data)
                share = decode(margins, code) if w.shape[1] else np.ones((len(known), 1))
                best = share.argmax(1)
                top = np.sort(share, 1)
                for row, k in enumerate(known):
                    pred[k] = langs[best[row]]
                score[known] = top[:, -1]
                close[known] = top[:, -1] - (top[:, -2] if share.shape[1] > 1 else 0) < CLOSE
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(close)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return map_arrow(docs.select(F.col(id_column).alias("doc_id"), "text"), run, f"doc_id {docs.schema[id_column].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def held_out_identification(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the rows of docs(doc_id, text, lang) whose remainder isn't 2, predict all: doc_id, held_out, lang_pred, score, ambiguous. A null doc_id is neither trained on nor held out."""
    model = learn(docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id")) != 2), sample)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
