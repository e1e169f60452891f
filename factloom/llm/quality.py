"""Quality: a document classifier combined with host and path posteriors by hierarchical empirical Bayes.

A logistic model over binned text statistics gives each document a probability of being good. Grouped sums of these give each host
and each path of a host a mean; a host's mean is shrunk toward the corpus mean, a path's toward its host's,
by prior strengths estimated from the spread between groups (method of moments), so sparse sites follow their prior.
The document's log odds and its path's shift against the corpus add up to the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.series import ranked_quantiles

from .common import map_arrow, materialize, release

#: Tasks that sum up a step of the fit, at most; each sends the driver one matrix of the weights.
FIT_TASKS = 16
#: Edges of a statistic's bins at quantiles of rows, and of distinct values; ridge penalty, and the part of the path's shift that counts.
BINS, RIDGE, SITE_WEIGHT = 10, 2.0, 1.0
#: Names of what measured() adds.
MEASURED = ("__digest", "__statistics")
LEVELS = np.linspace(0, 1, BINS + 2)[1:-1]
#: Documents with a lower probability are rejected.
THRESHOLD = 0.35
STATISTICS = ("words", "word_length", "distinct", "neighbours", "upper", "symbols", "digits", "capital_words", "compressed", "line_repeats", "odd_words", "long_words", "lone_symbols")

_LETTER, _UPPER, _DIGIT, _SPACE, _PROSE = (np.zeros(256, bool) for _ in range(5))
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PROSE[[ord(c) for c in ".,;:'\"()-?"]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _PROSE)


def statistics(text: str) -> list[float]:
    """STATISTICS of a whole text, each of about unit scale."""
    data = text.encode()
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    packed = size
    if data:
        z = zlib.compressobj(1)
        packed = sum(len(z.compress(data[i : i + (1 << 20)])) for i in range(0, len(data), 1 << 20)) + len(z.flush())
    rows = data.split(b"\n")
    return [
        np.log1p(len(words)), (size - counts[_SPACE].sum()) / n, len(set(words)) / n ** 0.9, sum(map(bytes.__eq__, words, words[1:])) / n,
        counts[_UPPER].sum() / size, counts[_SYMBOL].sum() / size, counts[_DIGIT].sum() / size, sum(map(bytes.istitle, words)) / n,
        packed / size ** 0.95, 1 - len(set(rows)) / len(rows), sum(not w[-1:].isalnum() and w[-1:] not in b".," and w[-1] < 128 for w in words) / n, sum(len(w) > 14 for w in words) / n,
        sum(len(w) == 1 and not w.isalnum() and w[0] < 128 for w in words) / n,
    ]


class Classifier(NamedTuple):
    """Bin edges of each statistic and a weight for each bin, the last one the offset."""

    edges: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return _binned(x, self.edges) @ self.weights


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(edges) * (edges.shape[1] + 1) + 1))
    for k, e in enumerate(edges):
        out[np.arange(len(x)), k * (edges.shape[1] + 1) + np.searchsorted(e, x[:, k], side="right")] = 1
    out[:, -1] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton's method. With one class only, or no rows, the prior alone."""
    edges = np.zeros((len(STATISTICS), 2 * BINS))
    for k in range(len(STATISTICS) if len(x) else 0):  # of all values, and of distinct ones: most rows may share one value
        edges[k] = np.sort(np.concatenate([np.quantile(x[:, k], LEVELS), np.quantile(np.unique(x[:, k].round(4)), LEVELS)]))
    d = _binned(x, edges)
    return _newton(edges, len(y), y.sum(), len(set(y.tolist())), lambda w: _sums(d, y, w))


def _sums(d: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of binned rows: the curvature at weights w, and the gradient as its last column."""
    p = 1 / (1 + np.exp(-d @ w))
    return np.concatenate([(d * (p * (1 - p))[:, None]).T @ d, (d.T @ (y - p))[:, None]], axis=1)


def _newton(edges: np.ndarray, n: int, good: float, classes: int, sums: Callable[[np.ndarray], np.ndarray]) -> Classifier:
    """The weights of n rows whose labels sum up to good; sums(w) as _sums has it, over all rows."""
    w = np.zeros(len(edges) * (edges.shape[1] + 1) + 1)
    w[-1] = np.log((good + 1) / (n - good + 1))
    if classes < 2:
        return Classifier(edges, w)
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(25):
        both = sums(w)
        step = np.linalg.solve(both[:, :-1] + np.diag(penalty), both[:, -1] - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(edges, w)


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Written: columns of docs(text, columns), and MEASURED: a hash of the text (null of a null one) and its statistics. A null text counts as empty."""

    def run(batches):
        for b in batches:
            x = [statistics(t or "") for t in b.column(len(columns) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*columns, *MEASURED])

    digest = F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias(MEASURED[0])
    schema = docs.select(*columns, digest, F.array(F.lit(0.0)).alias(MEASURED[1])).schema
    return materialize(map_arrow(docs.select(*columns, digest, "text"), run, schema), "statistics")


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on all rows of labels(doc_id, quality) and one text each in docs(doc_id, text), of several the one of the least hash. Rows with nulls are left out."""
    return _fit_all(measured(docs, ["doc_id"]), labels)


def _fit_all(stats: DataFrame, labels: DataFrame) -> Classifier:
    """fit() on measured() rows, without bringing them together: edges are exact quantiles of ranges, and each step of the fit is a sum over tasks."""
    labels = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("y")).distinct()
    rows = stats.select("doc_id", F.col(MEASURED[0]).alias("digest"), F.col(MEASURED[1]).alias("x")).where("digest is not null").join(labels, F.col("doc_id") == F.col("labelled"))
    rows = materialize(rows.groupBy("labelled", "y").agg(F.min(F.struct("digest", "x")).alias("row")).select("row.x", "y"), "labelled")  # doc_ids may repeat without bound
    n, good, classes = rows.agg(F.count("*"), F.sum("y"), F.count_distinct("y")).first()
    edges = np.zeros((len(STATISTICS), 2 * BINS))
    if n:
        values = rows.select(F.posexplode("x").alias("k", "v"))
        for at, of in ((0, values), (BINS, values.select("k", F.round("v", 4).alias("v")).distinct())):
            for r in ranked_quantiles(of, ["k"], "v", tuple(LEVELS)).collect():  # one row for each statistic
                edges[r["k0"], at : at + BINS] = [r[f"q{i}"] for i in range(BINS)]
        edges.sort(axis=1)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros((len(w), len(w) + 1))
            for b in batches:
                x = b.column(0).flatten().to_numpy().reshape(-1, len(edges))
                total += _sums(_binned(x, edges), b.column(1).to_numpy(), w)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part"])

        parts = map_arrow(rows.select("x", "y").coalesce(FIT_TASKS), run, "part array<double>").collect()
        return np.sum([np.array(r["part"]).reshape(len(w), -1) for r in parts], axis=0)

    out = _newton(edges, n, good or 0.0, classes, sums)
    release(rows)
    return out


def evidence(stats: DataFrame, classifier: Classifier, columns: list[str]) -> DataFrame:
    """columns of measured() rows and log_odds of each."""

    def run(batches):
        for b in batches:
            x = b.column(len(columns)).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(classifier.log_odds(x))], names=[*columns, "log_odds"])

    schema = stats.select(*columns, F.lit(0.0).alias("log_odds")).schema
    return map_arrow(stats.select(*columns, MEASURED[1]), run, schema)


def strength(sums: DataFrame, mean: Column) -> float:
    """Prior strength k, in documents, of groups with sums n, p, v (of p (1 - p)) around mean: within variance over variance between groups, 1 to 10000."""
    m = F.col("p") / F.col("n")
    got = sums.where("n >= 2").agg(
        F.sum(F.col("n") * (m - mean) ** 2).alias("spread"), F.sum("v").alias("v"), F.sum("n").alias("n"), F.count("*").alias("groups")
    ).first()
    if not got["groups"]:
        return 10.0
    noise = got["v"] / got["n"]
    between = max((got["spread"] - got["groups"] * noise) / got["n"], 0.0)
    return float(min(max(noise / between if between > 0 else 1e4, 1.0), 1e4))


class Prior(NamedTuple):
    """The corpus mean, and the prior strengths of hosts around it and of paths around their hosts."""

    corpus: float
    host: float
    path: float

    def means(self, p: Column | None = None) -> tuple[Column, Column]:
        """host_mean, shrunk toward the corpus, and path_mean, shrunk toward its host, of rows with the sums host_n, host_p, n, p of posteriors(); without a document of probability p, if given."""
        one, own = (0, F.lit(0.0)) if p is None else (1, p)
        host = (F.col("host_p") - own + self.host * self.corpus) / (F.col("host_n") - one + self.host)
        return host, (F.col("p") - own + self.path * host) / (F.col("n") - one + self.path)


def posteriors(scored: DataFrame) -> tuple[DataFrame, Prior]:
    """Of scored(host, path, log_odds): documents n, host_n and summed probabilities p, host_p of each host and path; and the prior that makes means of them."""
    p = 1 / (1 + F.exp(-F.col("log_odds")))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("p"), F.sum(p * (1 - p)).alias("v"))
    total = paths.agg(F.sum("n"), F.sum("p")).first()
    corpus = (total[1] + 0.5) / (total[0] + 1) if total[0] else 0.5
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "p", "v")])
    k = strength(hosts, F.lit(corpus))
    both = paths.join(hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("p").alias("host_p")), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    prior = Prior(corpus, k, strength(both, Prior(corpus, k, 0.0).means()[0]))
    return both.select("host", "path", "n", "p", "host_n", "host_p"), prior


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD, carry: tuple[Column, ...] = ()) -> DataFrame:
    """Score each row of docs(doc_id, text and what host and path need): doc_id, doc_score, host_score, path_score, quality_score, kept; with the named columns of carry after doc_id.

    host and path default to source, and source with lang. Null hosts and paths are groups of their own. A row is kept if quality_score >= threshold.
    host_score and path_score are the posteriors without the row itself; a row alone in its host has the corpus mean. Null and empty texts are scored as empty. Repeated rows are scored each. An empty table gives an empty result; with no usable label all scores are 0.5 or so and all rows are kept.
    The groups' sums are small and the texts don't move: the rows that are joined with the groups hold a doc_id, a host, a path and a number.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    slim = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), *carry, "text")
    own = slim.columns[:-1]
    stats = measured(slim, own)
    scored = materialize(evidence(stats, _fit_all(stats, labels), own), "evidence")
    release(stats)
    sums, prior = posteriors(scored)
    sums = sums.withColumnsRenamed({"host": "of_host", "path": "of_path"})
    logit = lambda x: F.log(x / (1 - x))
    joined = scored.join(sums, scored["host"].eqNullSafe(sums["of_host"]) & scored["path"].eqNullSafe(sums["of_path"]))
    host_mean, path_mean = prior.means(1 / (1 + F.exp(-F.col("log_odds"))))  # what the others tell, so that no document confirms itself
    joined = joined.withColumns({"host_mean": host_mean, "path_mean": path_mean})
    shift = logit(F.least(F.greatest("path_mean", F.lit(1e-3)), F.lit(1 - 1e-3))) - F.log(F.lit(prior.corpus / (1 - prior.corpus)))
    combined = 1 / (1 + F.exp(-(F.col("log_odds") + SITE_WEIGHT * shift)))
    out = joined.select("doc_id", *slim.columns[3:-1], (1 / (1 + F.exp(-F.col("log_odds")))).alias("doc_score"), F.col("host_mean").alias("host_score"), F.col("path_mean").alias("path_score"), combined.alias("quality_score"))
    return out.withColumn("kept", F.col("quality_score") >= threshold)
