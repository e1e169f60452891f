"""Centroid clustering with Drake's adaptive bounds, exact in integers.

Every vector keeps the numbers of its nearest centroids in order, an upper bound of the distance to the first, a lower bound for each of the others, and one remainder
bound below the distances to all the rest. When centroids move, bounds move by as much. A vector whose upper bound lies below all its lower bounds stays where it is without
any distance; else the first bounds that the true distance to its own centroid doesn't reach are certified, only the centroids before them are measured and put in order,
and where not even the remainder bound holds all centroids are. How many bounds are kept shrinks to what the last round needed.

Vectors with their bounds are a table in the shared folder that each round rewrites; the one before it goes. Sums come from one row for each task and cluster,
so nothing is collected but centroids. Bounds are floats with a margin for rounding; distances that decide are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, release

#: Components beyond this count as this, so that squared distances stay within 63 bits.
MOST = 1 << 27
#: A bound's share that rounding may cost.
SLACK = 1e-9


def integers(vectors: DataFrame, dims: int, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id and x, the integers floor(scale * component), of vectors with exactly dims components, none null or non-finite. Beyond MOST they count as MOST."""
    kind = vectors.schema[id_column].dataType.simpleString()
    raw = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).where(F.size("v") == dims).where(~F.exists("v", lambda c: c.isNull()))

    def run(batches):
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dims)
            fit = np.isfinite(v).all(1)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(v[fit] * scale), -MOST, MOST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(fit)), _lists(x)], names=["id", "x"])

    return map_arrow(raw, run, f"id {kind}, x array<int>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c. Floats where they hold every intermediate value."""
    top = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def assign(x: np.ndarray, centroids: np.ndarray, order: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None, drift: np.ndarray | None, bounds: int) -> tuple:
    """order (numbers of the nearest centroids, own first), upper, lower (one for each of the others, then the remainder's) and needed, for x after centroids moved by drift.

    needed: 0 if the bounds alone certified the vector, else how many centroids other than its own were measured. Without order all are.
    """
    n, k = len(x), len(centroids)
    bounds = min(bounds, k - 1)
    if order is None:
        fresh = np.ones(n, bool)
        order, upper, lower, needed = np.zeros((n, bounds + 1), np.int64), np.zeros(n), np.zeros((n, bounds + 1)), np.full(n, k - 1)
    else:
        lower = np.concatenate([lower[:, :-1] - drift[order[:, 1:]], lower[:, -1:] - drift.max(initial=0)], 1)
        lower = np.minimum.accumulate(lower[:, ::-1], 1)[:, ::-1]  # each below the distances to all that follow
        order, lower = order[:, : bounds + 1].copy(), lower[:, : bounds + 1].copy()  # the first bound that goes becomes the remainder's
        upper = upper + drift[order[:, 0]]
        needed = np.zeros(n, np.int64)
        fresh = np.zeros(n, bool)
        open_ = np.flatnonzero(upper * (1 + SLACK) >= lower[:, 0] * (1 - SLACK))
        own = ((x[open_] - centroids[order[open_, 0]]) ** 2).sum(1)
        upper[open_] = _root(own)
        failing = (upper[open_, None] * (1 + SLACK) >= lower[open_] * (1 - SLACK)).sum(1)  # bounds don't fall along a row
        for z in range(1, bounds + 1):
            rows = open_[failing == z]
            if len(rows):
                near = order[rows, : z + 1]
                d = ((x[rows, None, :] - centroids[near]) ** 2).sum(2)
                by = np.lexsort((near, d), axis=1)
                near, d = np.take_along_axis(near, by, 1), np.take_along_axis(d, by, 1)
                order[rows, : z + 1], upper[rows], lower[rows, :z] = near, _root(d[:, 0]), _root(d[:, 1:])
                needed[rows] = z
        fresh[open_[failing > bounds]] = True
        needed[fresh] = k - 1
    rows = np.flatnonzero(fresh)
    if len(rows):
        d = squared(x[rows], centroids)
        by = np.argsort(d, axis=1, kind="stable")  # of equal distances the smaller number first
        ranked = _root(np.take_along_axis(d, by, 1))
        order[rows], upper[rows] = by[:, : bounds + 1], ranked[:, 0]
        lower[rows, :-1] = ranked[:, 1 : bounds + 1]
        lower[rows, -1] = ranked[:, bounds + 1] if bounds + 1 < k else np.inf
    return order, upper, lower, needed


def _assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, kept: int, bounds: int) -> DataFrame:
    """state with bounds after centroids moved. kept: the bounds that its rows hold."""
    kind, first = state.schema["id"].dataType.simpleString(), "near" not in state.columns
    dims, bounds = centroids.shape[1], min(bounds, len(centroids) - 1)

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), dims, np.int64)
            if first:
                own = np.full(len(x), -1)
                order, upper, lower, needed = assign(x, centroids, None, None, None, None, bounds)
            else:
                near = _matrix(b.column(2), kept + 1, np.int64)
                own = near[:, 0].copy()
                order, upper, lower, needed = assign(x, centroids, near, b.column(3).to_numpy(), _matrix(b.column(4), kept + 1, np.float64), drift, bounds)
            columns = [b.column(0), b.column(1), _lists(order.astype(np.int32)), pa.array(upper), _lists(lower), pa.array(own.astype(np.int32)), pa.array(needed.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "near", "upper", "lower", "was", "needed"])

    rows = state.select("id", "x") if first else state.select("id", "x", "near", "upper", "lower")
    return map_arrow(rows, run, f"id {kind}, x array<int>, near array<int>, upper double, lower array<double>, was int, needed int")


def _changes(state: DataFrame, dims: int, k: int) -> dict[int, list[int]]:
    """By cluster: the sums of components, then the count, that the last round's moves add; one row leaves a task for each cluster."""

    def run(batches):
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            x = np.concatenate([_matrix(b.column(0), dims, np.int64), np.ones((b.num_rows, 1), np.int64)], 1)
            was, now = b.column(1).to_numpy(), b.column(2).to_numpy()
            np.add.at(total, now, x)
            np.subtract.at(total, was[was >= 0], x[was >= 0])
        for c in range(k):
            if total[c].any():
                yield pa.RecordBatch.from_arrays([pa.array([c] * (dims + 1), pa.int32()), pa.array(range(dims + 1), pa.int32()), pa.array(total[c])], names=["cluster", "place", "total"])

    moved = state.select("x", "was", F.col("near")[0].alias("now")).where("was <> now")
    sums = map_arrow(moved, run, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = {c: [0] * (dims + 1) for c in range(k)}
    for r in sums.collect():  # k * (dims + 1) at most
        out[r["cluster"]][r["place"]] = int(r["total"])
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding", bounds: int | None = None) -> tuple[DataFrame, list[tuple[int, ...]], list[dict]]:
    """Rows (id, cluster, distance) of the vectors that integers() keeps, the final centroids, and for each assignment the bounds kept and how many vectors needed which measuring.

    Centroids start as the k vectors whose `seed:id` has the least SHA-256 (of equal ids, the least vectors), in that order; fewer vectors make fewer centroids. Then rounds times every vector goes to the
    nearest centroid (squared Euclidean distance; ties: the smaller number), and every centroid that has vectors becomes their componentwise floor(sum / count); at last vectors are assigned
    once more. Rows that repeat count as often as they are there. Vectors with a null id are clustered but start no centroid; without any centroid, cluster and distance are null.
    An empty table gives an empty result. Other columns are ignored.
    """
    state = materialize(integers(vectors, dims, scale, id_column, vector_column), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    centroids = [tuple(r["x"]) for r in state.where("id is not null").select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()]
    if not centroids:
        return state.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), [], []
    k = len(centroids)
    keep = kept = max(1, k // 4) if bounds is None else bounds
    totals = {c: [0] * (dims + 1) for c in range(k)}
    drift, told = None, []
    for step in range(rounds + 1):
        now = np.array(centroids, np.int64)
        after = materialize(_assigned(state, now, drift, min(kept, k - 1), keep), "bounds")
        release(state)
        state, kept = after, keep
        needed = {r["needed"]: r["n"] for r in state.groupBy("needed").agg(F.count("*").alias("n")).collect()}  # k at most
        told.append({"bounds": kept, "needed": needed})
        if step == rounds:
            break
        partly = [z for z in needed if z <= kept]
        if step and bounds is None:
            keep = max(1, k // 8, min(kept, max(partly, default=0)))
        for c, change in _changes(state, dims, k).items():
            totals[c] = [a + b for a, b in zip(totals[c], change, strict=True)]
        moved = [tuple(s // t[-1] for s in t[:-1]) if (t := totals[c])[-1] else centroids[c] for c in range(k)]
        away = [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for p, q in zip(moved, centroids, strict=True)]
        drift = np.sqrt(np.array(away, np.float64)) * (1 + SLACK)
        centroids = moved
    final = np.array(centroids, np.int64)

    def measure(batches):
        for b in batches:
            own = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(((_matrix(b.column(1), dims, np.int64) - final[own]) ** 2).sum(1))], names=["id", "cluster", "distance"])

    rows = state.select("id", "x", F.col("near")[0].alias("cluster"))
    return map_arrow(rows, measure, f"id {state.schema['id'].dataType.simpleString()}, cluster int, distance long"), centroids, told


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """For each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Sums beyond a long count as its largest value."""
    rows, centroids, _ = cluster(vectors)
    if not centroids:
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", *nothing)
    found = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fit = lambda s: min(s, (1 << 63) - 1)
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = [(c, fit(found.get(c, 0)), fit(sum(found.values())), text[c]) for c in range(len(centroids))]
    table = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # as many rows as centroids


def _oracle() -> str:
    distance = "list_sum(list_transform(range(1, 65), lambda i: (k.x[i] - c.x[i]) * (k.x[i] - c.x[i])))"
    parts = []
    for r in range(4):
        parts.append(f"a{r} AS (SELECT k.r, arg_min(c.c, ({distance}, c.c)) AS c, min({distance}) AS d FROM kept k CROSS JOIN c{r} c GROUP BY k.r)")
        if r < 3:
            parts.append(f"""m{r} AS (SELECT c, list(v ORDER BY i) AS x FROM (
              SELECT a.c, i, floor(sum(k.x[i])::DOUBLE / count(*))::BIGINT AS v FROM a{r} a JOIN kept k USING (r), range(1, 65) t(i) GROUP BY a.c, i) GROUP BY c)""")
            parts.append(f"c{r + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda e: floor(64 * e)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding::DOUBLE[], lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 16)),
{", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)},
inertia AS (SELECT c, sum(d)::BIGINT AS own FROM a3 GROUP BY c)
SELECT vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, own AS cluster_inertia, (SELECT sum(own) FROM inertia)::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 a JOIN kept USING (r) JOIN c3 ON c3.c = a.c JOIN inertia ON inertia.c = a.c
"""


ORACLE_SQL = _oracle()
