"""Centroid clustering (Lloyd's rounds in whole numbers) with exponion search.

A component x becomes floor(scale * x), so all distances, sums and means are whole numbers and every run, however its
rows are dealt, ends with the same centroids. Each vector carries its centroid, an upper bound of its distance to it and
a lower bound of its distance to every other one, which each round loosens by how far centroids have moved. A vector
whose upper bound is below the lower one, or below half the distance of its centroid to the next, keeps its centroid
unseen. Of the others the upper bound is tightened to the true distance u, and if that isn't enough, only centroids in
the ball of radius 2u + s around the current one are scanned, s being the distance to the nearest other centroid: the
nearest and the second nearest lie in it. The ball is a beginning of the list of centroids by distance from the current
one. The radius is inclusive and a vector is skipped only if its bounds are truly apart, so that a centroid at the same
distance with a smaller number is always met. Bounds are floating point and err to the safe side by SLACK.

A round is one narrow pass over the vectors, which Spark caches with their bounds, and one aggregate of k sums that each
task has added up beforehand; no vector is shuffled, and the driver holds k centroids only. The cache may spill and its
lost parts are computed again from the table through the centroids of the rounds before; the lineage is cut every
CUT_EVERY rounds.

Defined cases: a vector that is null, has another length, or holds null or non-finite components takes no part; a
component of which scale * x lies beyond 2**27 makes the operator fail, since distances might not fit in a long; with
fewer vectors than k each is a centroid; repeated rows are rows of their own and may both seed, as may equal vectors,
and the smaller number then wins every tie; a null vec_id takes part and seeds last; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exactdiff.llm.common import cut

DIMENSION, K, ROUNDS, SCALE = 64, 8, 10, 1024
MOST = 1 << 27
SLACK = 1e-9
CUT_EVERY = 12
#: Rows that are compared together.
_TOGETHER = 1 << 14


def usable(v: Column, dimension: int) -> Column:
    """Whether a vector has the dimension and only finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite, F.lit(False))


class Centroids:
    """k centroids, what the rounds of a search need of them, and how far each has moved since the last round."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None) -> None:
        self.at = at
        self.square = (at * at).sum(1)
        gap = np.sqrt((self.square[:, None] + self.square[None, :] - 2 * (at @ at.T)).astype(np.float64))
        #: Of each centroid the others by their distance from it, and these distances.
        np.fill_diagonal(gap, -1.0)
        self.order = np.argsort(gap, axis=1, kind="stable")[:, 1:]
        np.fill_diagonal(gap, 0.0)
        self.gap = np.take_along_axis(gap, self.order, 1)
        self.nearest = self.gap[:, 0] if len(at) > 1 else np.full(len(at), np.inf)
        self.moved = None if before is None else np.sqrt(((at - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)

    def distances(self, x: np.ndarray, square: np.ndarray, to: np.ndarray | int) -> np.ndarray:
        """Squared distances of rows, each to one centroid, exactly."""
        c = self.at[to]
        dot = (x * c).sum(1) if c.ndim == 2 else x @ c
        return square + self.square[to] - 2 * dot


def assign(x: np.ndarray, centroids: Centroids, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid, the bounds, and the squared distance or -1 where it was not needed.
    scanned: takes how many distances were computed."""
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    known = np.full(len(x), -1, np.int64)
    if centroids.moved is not None:
        upper += centroids.moved[own]
        # the farthest move of another centroid
        first, *rest = np.sort(centroids.moved)[::-1]
        lower -= np.where(centroids.moved[own] == first, rest[0] if rest else 0.0, first)
        lower = np.maximum(lower, 0.0)
    half = centroids.nearest / 2 * (1 - SLACK)
    unsure = np.flatnonzero(upper >= np.maximum(lower, half[own]))
    if not len(unsure):
        return own, upper, lower, known
    square = np.zeros(len(x), np.int64)
    square[unsure] = (x[unsure] * x[unsure]).sum(1)
    d = centroids.distances(x[unsure], square[unsure], own[unsure])
    known[unsure], upper[unsure] = d, np.sqrt(d.astype(np.float64)) * (1 + SLACK)
    n = len(unsure)
    unsure = unsure[upper[unsure] >= np.maximum(lower[unsure], half[own[unsure]])]
    for a in np.unique(own[unsure]).tolist():
        rows = unsure[own[unsure] == a]
        radius = (2 * upper[rows] + centroids.nearest[a]) * (1 + SLACK)
        ball = np.searchsorted(centroids.gap[a], radius, side="right")
        rows = rows[np.argsort(-ball, kind="stable")]
        inside = np.sort(ball)[::-1]
        best, number, second = known[rows].copy(), np.full(len(rows), a), np.full(len(rows), np.iinfo(np.int64).max)
        for j in range(int(inside[0]) if len(inside) else 0):
            some = int(np.searchsorted(-inside, -j, side="left"))  # rows whose ball holds the j-th centroid
            c = int(centroids.order[a, j])
            d = centroids.distances(x[rows[:some]], square[rows[:some]], c)
            n += some
            nearer = (d < best[:some]) | ((d == best[:some]) & (c < number[:some]))
            second[:some] = np.where(nearer, best[:some], np.minimum(second[:some], d))
            best[:some], number[:some] = np.where(nearer, d, best[:some]), np.where(nearer, c, number[:some])
        own[rows], known[rows] = number, best
        upper[rows] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        # the second nearest is in the ball; if the ball holds no other centroid, there is only one
        lower[rows] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(np.float64)) * (1 - SLACK))
    if scanned is not None:
        scanned.append(n)
    return own, upper, lower, known


STATE = "vec_id long, vector binary, cluster int, upper double, lower double"


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dimension).astype(np.int64)


def prepare(vectors: DataFrame, dimension: int, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and vector (little-endian 32-bit whole numbers) with the state of vectors that no search has seen."""
    clean = vectors.where(usable(F.col(embedding), dimension)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = np.floor(scale * np.asarray(b.column(1).flatten()).reshape(len(b), dimension))
            if (np.abs(x) > MOST).any():
                raise ValueError(f"a component times {scale} lies beyond {MOST}, so distances might not fit in a long")
            rows = [r.tobytes() for r in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), pa.array(np.zeros(len(b), np.int32)), pa.array(np.full(len(b), np.inf)), pa.array(np.zeros(len(b)))], names=["vec_id", "vector", "cluster", "upper", "lower"])

    return clean.mapInArrow(run, STATE)


def seeds(prepared: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose vec_id has the smallest hash."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = prepared.select("vector", order.alias("h")).orderBy(F.asc_nulls_last("h"), "vector").limit(k).collect()
    return np.array([np.frombuffer(r.vector, "<i4") for r in rows], np.int64)


def searched(state: DataFrame, at: np.ndarray, before: np.ndarray | None, distances: bool = False) -> DataFrame:
    """The state after one search of all vectors; with distances (squared) in place of the bounds for the last one."""
    dimension = at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(at, before)
        for whole in batches:
            for lo in range(0, len(whole), _TOGETHER):
                b = whole.slice(lo, _TOGETHER)
                x = _matrix(b.column(1), dimension)
                own, upper, lower, known = assign(x, centroids, b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy())
                if distances:
                    missing = np.flatnonzero(known < 0)
                    known[missing] = centroids.distances(x[missing], (x[missing] * x[missing]).sum(1), own[missing])
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), pa.array(known)], names=["vec_id", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower)], names=["vec_id", "vector", "cluster", "upper", "lower"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long" if distances else STATE)


def sums(state: DataFrame, k: int, dimension: int) -> list:
    """cluster, n, total (a list): the sums of each cluster's vectors; every task sends one row for each cluster it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, own = _matrix(b.column(1), dimension), b.column(2).to_numpy()
            for c in np.unique(own).tolist():
                total[c] += x[own == c].sum(0)
            n += np.bincount(own, minlength=k)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = state.select("vec_id", "vector", "cluster").mapInArrow(run, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    return each.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("total")).collect()


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, salt: str = "3:", vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[np.ndarray, DataFrame]:
    """The final centroids and, of each vector that takes part, vec_id, cluster and distance (squared)."""
    prepared = prepare(vectors, dimension, scale, vec_id, embedding)
    at, before, state = seeds(prepared, k, salt), None, prepared
    if not len(at):
        return at, state.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"))
    held: DataFrame | None = None
    for r in range(rounds):
        state = searched(state, at, before)
        state = cut(state) if r % CUT_EVERY == CUT_EVERY - 1 else state
        state = state.persist()
        new = at.copy()
        for row in sums(state, len(at), dimension):
            new[row.cluster] = [int(x.x) // row.n for x in row.total]
        if held is not None:
            held.unpersist()
        held, at, before = state, new, at
    found = cut(searched(state, at, before, distances=True))
    if held is not None:
        held.unpersist()
    return at, found


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, salt: str = "3:", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance of each vector, cluster_inertia, inertia, and the hash of its centroid."""
    at, found = fit(vectors, k, rounds, dimension, scale, salt, vec_id, embedding)
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(at)]
    of_cluster = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
