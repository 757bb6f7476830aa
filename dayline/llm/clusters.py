"""Centroid clustering with Hamerly's bounds: each vector keeps one upper bound of the distance to its centroid and one lower bound of the distance to any other.

When centroids move, the upper bound grows by the drift of the vector's own centroid and the lower one falls by
the largest drift of the others. While the upper one stays below the lower one, or below half the way from its
centroid to the next, no other centroid can be as near, and the vector is not looked at. Else the upper bound is
made exact, and if that does not settle it the vector is held against all centroids, in whole numbers.

Vectors with their bounds are a written table of one round that the next one reads and rewrites, task by task
without a shuffle; a round's sums leave a task as one row for each centroid. Centroids (k rows of dim whole
numbers) are the only thing that the driver holds and sends out; they are bounded by the parameters.

Distances are exact whole numbers, bounds are their roots with a margin far above rounding, and ties are
ambiguous, so they are always settled by a scan, for the smaller number.

Defined cases: a vector that is null, has another number of components than dim, or one that is null or not
finite takes no part, nor does one with a scaled component beyond 2^26, whose squares leave 64 bits; repeated
rows are vectors of their own; a null id comes last among the first centroids; with fewer vectors than k all are
centroids; empty clusters keep their centroid; sums beyond 64 bits are null; no vectors give no rows; other
columns are not used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .topk import products

#: Magnitude of a scaled component at most.
MOST = 1 << 26
#: Vectors that are held against all centroids at once.
ROWS = 8192
#: Bounds are widened by these, relative and absolute, which is more than rounding can take from them.
WIDER, EDGE = 1e-12, 1e-9


def whole_vectors(df: DataFrame, dim: int, scale: float, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v, the floors of the scaled components, of the vectors that take part."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).where(F.size("e") == dim)
    fits = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= F.lit(float(MOST))))
    return rows.where(fits).select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(scale)).cast("int")).alias("v"))


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v to all centroids."""
    return (v * v).sum(axis=1)[:, None] - 2 * products(v, centroids) + (centroids * centroids).sum(axis=1)[None, :]


def upper_root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + WIDER) + EDGE


def lower_root(d: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(d.astype(np.float64)) * (1 - WIDER) - EDGE, 0)


class Move:
    """Centroids after a move: their drifts, and half of each one's way to the next."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        k = len(centroids)
        apart = squared(centroids, centroids)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.half = lower_root(apart.min(axis=1)) / 2
        drift = np.zeros(k) if before is None else upper_root(((centroids - before) ** 2).sum(axis=1))
        order = np.argsort(-drift, kind="stable")
        self.drift = drift
        self.others = np.full(k, drift[order[0]])  # the largest drift of any other
        self.others[order[0]] = drift[order[1]] if k > 1 else 0

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """cluster, upper and lower after the move, and how many vectors were held against all centroids. A cluster of -1 is not known yet."""
        known = cluster >= 0
        at = np.where(known, cluster, 0)
        upper, lower = (upper + self.drift[at]) * (1 + WIDER), np.maximum(lower - self.others[at] - EDGE, 0)
        doubtful = np.flatnonzero(~known | (upper >= np.maximum(lower, self.half[at])))
        own = doubtful[known[doubtful]]
        upper[own] = upper_root(((v[own] - self.centroids[at[own]]) ** 2).sum(axis=1))
        doubtful = doubtful[~known[doubtful] | (upper[doubtful] >= np.maximum(lower[doubtful], self.half[at[doubtful]]))]
        cluster = at.copy()
        for first in range(0, len(doubtful), ROWS):
            rows = doubtful[first : first + ROWS]
            d = squared(v[rows], self.centroids)
            best = d.argmin(axis=1)  # the first of equals
            cluster[rows], upper[rows] = best, upper_root(d[np.arange(len(rows)), best])
            d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
            lower[rows] = lower_root(d.min(axis=1)) if d.shape[1] > 1 else np.inf
        return cluster, upper, lower, len(doubtful)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


STATE = "vec_id long, v array<int>, cluster int, upper double, lower double"


def _assign(move: Move, dim: int):
    def run(batches):
        for batch in batches:
            cluster, upper, lower = (batch[c].to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, _ = move.assign(matrix(batch["v"], dim), cluster, upper, lower)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], names=["vec_id", "v", "cluster", "upper", "lower"])

    return run


def _sums(k: int, dim: int):
    """One row for each cluster of a task: its vectors and the sums of their components."""

    def run(batches):
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            cluster = batch["cluster"].to_numpy()
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(cluster[order]) != 0)) if len(order) else order
            if len(order):
                total[cluster[order][first]] += np.add.reduceat(matrix(batch["v"], dim)[order], first, axis=0)
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), lists], names=["cluster", "n", "total"])

    return run


def _distances(centroids: np.ndarray, dim: int):
    def run(batches):
        for batch in batches:
            cluster = batch["cluster"].to_numpy()
            d = ((matrix(batch["v"], dim) - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["cluster"], pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of each cluster's vectors, exact; empty ones as they were."""
    k, dim = centroids.shape
    parts = state.select("v", "cluster").mapInArrow(_sums(k, dim), "cluster int, n long, total array<long>")
    sums = [F.sum(F.col("total")[i].cast("decimal(20,0)")).alias(f"t{i}") for i in range(dim)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # k rows at most
        out[r["cluster"]] = [int(r[f"t{i}"]) // r["n"] for i in range(dim)]
    return out


def cluster(vectors: DataFrame, first: Column, *, k: int, dim: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Rows vec_id, cluster and distance (squared) of vectors (vec_id, v) after so many rounds, and the centroids. The first centroids are the k vectors that are smallest by the column first."""
    state = stored(vectors.withColumns({"cluster": F.lit(-1), "upper": F.lit(0.0), "lower": F.lit(0.0)}), "vectors")
    chosen = state.select("v", first.alias("first"), "vec_id").orderBy(F.col("first").asc_nulls_last(), F.col("vec_id").asc_nulls_last(), "v").limit(k).collect()
    if not chosen:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), np.empty((0, dim), dtype=np.int64)
    before, centroids = None, np.array([r["v"] for r in chosen], dtype=np.int64)
    for n in range(rounds + 1):
        now = stored(state.mapInArrow(_assign(Move(centroids, before), dim), STATE), f"assigned-{n}")
        drop_stored(state)
        state = now
        if n < rounds:
            before, centroids = centroids, moved(state, centroids)
    return state.select("vec_id", "v", "cluster").mapInArrow(_distances(centroids, dim), "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with the distances summed over each cluster and over all, and each cluster's sha256 of its centroid's components in decimal, joined by commas."""
    assigned = stored(assigned, "distances")
    sums = {r["cluster"]: r["x"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("x")).collect()}  # k rows at most
    whole = lambda x: int(x) if x < 2**63 else None
    told = [(n, whole(x), whole(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[n].tolist())).encode()).hexdigest()) for n, x in sums.items()]
    told = assigned.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
