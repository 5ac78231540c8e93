"""Approximate nearest neighbours by largest inner product, by collision counting.

Vectors are lifted to one more dimension, `[x / M, sqrt(1 - |x|^2 / M^2)]` with M the largest length, and queries to
`[q / |q|, 0]`, so that the largest inner product is the least distance. Every row is dealt to a block; a block's index
holds, for each of some random directions, its rows sorted by their projection. Directions are the axes of whole random
rotations, which makes the count of collisions vary less than independent directions would.

A query looks for all rows within a radius R: it opens a window of half-width `WIDTH * R` around its own projection in
every sorted array and counts in how many windows a row lies. The threshold is the expected count of a row at distance
R, less SURE standard deviations, so that a row at R or nearer misses it with a known small probability, whatever the
number of rows. A row that reaches it is a candidate and is verified: its inner product with the query in double
precision on the vectors as given. A query is done when its k-th best verified row is no farther than R. Else virtual
rehashing widens all its windows: to the distance of that k-th row if there are k, which then is enough, or to the next
of the distances to a k-th part of the block's rows, from which the first radius is taken too. At last the windows
cover the arrays. A query's best of all blocks are its result.

Queries are dealt to blocks too, and each pair of a row block and a query block is one bounded task, so memory is that
of two blocks and nothing is broadcast. Work grows with rows times queries.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
vec_id; vectors of different lengths do not meet; a query's own vec_id is no candidate; ties go to the smaller vec_id;
with fewer candidates than k all are returned; equal rows are candidates each, but ask once; rows of one vec_id with
different vectors ask each for itself, and their results stand under the same query_id; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directions: as many whole rotations as give LEAST or more, cut at MOST.
LEAST, MOST = 130, 255
#: Half-width of a window in units of R, at which counts tell distances apart best.
WIDTH = 1.5
#: A row at distance R misses the threshold with the probability of a normal value below -SURE, 0.16; a nearer row with
#: a lower one.
SURE = 1.0
ROWS, QUERIES = 8192, 16384
_TOGETHER = 128


def usable(v: Column) -> Column:
    """Neither null nor zero nor with a component that is null or not finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def directions(dimension: int) -> np.ndarray:
    """Columns of length sqrt(dimension + 1), so that a difference of length 1 has projections of variance 1."""
    random, lifted = np.random.default_rng([20240607, dimension]), dimension + 1
    turns = [np.linalg.qr(random.standard_normal((lifted, lifted)))[0] for _ in range(-(-LEAST // lifted))]
    return (np.concatenate(turns, axis=1)[:, :MOST] * math.sqrt(lifted)).astype(np.float32)


def threshold(lifted: int, n_directions: int) -> int:
    """The least number of collisions of a candidate."""
    p = math.erf(WIDTH / math.sqrt(2))
    # what the sum of squares, fixed by a whole rotation, explains of a collision
    bell = math.exp(-WIDTH * WIDTH / 2) / math.sqrt(2 * math.pi)
    explained = (2 * WIDTH * bell) ** 2 / (2 * p * (1 - p)) * min(1.0, n_directions / lifted)
    return math.floor(n_directions * p - SURE * math.sqrt(n_directions * p * (1 - p) * (1 - explained)))


class Index:
    """The sorted projections of one block. x: its vectors (float64); longest: M."""

    def __init__(self, x: np.ndarray, longest: float) -> None:
        rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1) / longest**2))
        self.directions = directions(x.shape[1])
        p = np.column_stack((x / longest, rest)).astype(np.float32) @ self.directions
        order = np.argsort(p, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, order, axis=0).T)
        self.place = np.empty((p.shape[1], len(x)), np.uint8)
        np.put_along_axis(self.place, order.T, np.broadcast_to(self.part(np.arange(len(x)), len(x)), self.place.shape), axis=1)
        self.rows, self.least = len(x), threshold(x.shape[1] + 1, p.shape[1])

    @staticmethod
    def part(place: np.ndarray, rows: int) -> np.ndarray:
        """Which of 256 equal parts of a sorted array a place is in."""
        return (place * 256 // rows).astype(np.uint8)

    def project(self, q: np.ndarray) -> np.ndarray:
        return (q / np.sqrt((q * q).sum(1, keepdims=True))).astype(np.float32) @ self.directions[:-1]

    def candidates(self, p: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each query, given by its projections, which rows reach the threshold at its radius. Windows are widened
        to whole parts of the sorted arrays."""
        count = np.zeros((len(p), self.rows), np.uint8)
        off, inside = np.empty_like(count), np.empty(count.shape, bool)
        half = (WIDTH * radius).astype(np.float32)
        for j in range(len(self.sorted)):
            first = np.searchsorted(self.sorted[j], p[:, j] - half)
            last = np.searchsorted(self.sorted[j], p[:, j] + half, side="right") - 1
            lo = self.part(np.minimum(first, self.rows - 1), self.rows)
            hi = np.maximum(lo, self.part(np.maximum(last, 0), self.rows))
            np.subtract(self.place[j][None, :], lo[:, None], out=off)
            np.less_equal(off, (hi - lo)[:, None], out=inside)
            np.add(count, inside.view(np.uint8), out=count)
        return count >= self.least


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, longest: float, verified: list[int] | None = None) -> tuple[list[int], list[int], list[float]]:
    """Place of the query, vec_id and score of each query's k best candidates in a block. verified: takes the number of
    rows that each query verified."""
    index = Index(x, longest)
    sample = np.random.default_rng(len(x)).permutation(len(x))[: -(-len(x) // k)]
    a, b, s = [], [], []
    for start in range(0, len(q), _TOGETHER):
        part, names = q[start : start + _TOGETHER], query_ids[start : start + _TOGETHER]
        length, p = np.sqrt((part * part).sum(1)), index.project(part)
        away = lambda score, i: np.sqrt(np.maximum(2 - 2 * score / (length[i] * longest), 1e-6)) * 1.0001
        ladder = away((part @ x[sample].T).T, np.arange(len(part))).T
        ladder[ids[sample][None, :] == names[:, None]] = np.inf
        ladder.sort(axis=1)
        radius, step = ladder[:, 0].copy(), np.ones(len(part), np.int64)
        opened = np.arange(len(part))
        while len(opened):
            again = []
            for i, hit in zip(opened, index.candidates(p[opened], radius[opened])):
                found = np.flatnonzero(hit)
                found = found[ids[found] != names[i]]
                score = (x[found] * part[i]).sum(1)
                if np.isfinite(radius[i]):
                    far = away(np.partition(score, len(score) - k)[len(score) - k], i) if len(score) >= k else np.inf
                    if far > radius[i]:
                        rung = ladder[i, step[i]] if step[i] < len(sample) else np.inf
                        radius[i] = far if np.isfinite(far) else max(rung, radius[i] * 1.0001)
                        step[i] *= 2
                        again.append(i)
                        continue
                best = np.lexsort((ids[found], -score))[:k]
                a += [start + int(i)] * len(best)
                b += ids[found][best].tolist()
                s += score[best].tolist()
                if verified is not None:
                    verified.append(len(found))
            opened = np.array(again, np.int64)
    return a, b, s


def asking(ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows ask, equal ones once, in order of their id, and the number of each among those of its id."""
    rows = sorted({(int(i), v.tobytes()): at for at, (i, v) in enumerate(zip(ids, q))}.items())
    number, last = [], None
    for (name, _), _ in rows:
        number.append(number[-1] + 1 if number and name == last else 0)
        last = name
    return np.array([at for _, at in rows], np.int64), np.array(number, np.int64)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row for which is_query holds."""
    clean = vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull())
    rows = clean.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("d", F.size("v"))
    n, askers, longest = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)))).first()
    parts, query_parts = max(1, -(-n // ROWS)), max(1, -(-askers // QUERIES))
    longest = float(longest or 1.0)
    spread = F.xxhash64("vec_id")
    data = rows.select("d", F.pmod(spread, F.lit(parts)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("asked"), "vec_id", "v")
    # columns of other names than data's: Spark takes columns of one origin on both sides of a cogroup for one another
    ask = rows.where("asks").select(F.col("d").alias("length"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"), F.pmod(F.shiftright(spread, 20), F.lit(query_parts)).cast("int").alias("asked"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, numbers, b, s = [], [], [], []
        if len(left) and len(right):
            matrix = lambda t, name: np.asarray(t.column(name).combine_chunks().flatten()).reshape(len(t), -1)
            whole, at = matrix(left, "v"), left.column("vec_id").to_numpy()
            order = np.argsort(at, kind="stable")  # the order of arrival is not the same at each try
            whole, at = whole[order], at[order]
            q, ids = matrix(right, "q"), right.column("query_id").to_numpy()
            who, number = asking(ids, q)
            # a block may come out larger than planned
            for lo in range(0, len(whole), 4 * ROWS):
                which, found, score = search_block(at[lo : lo + 4 * ROWS], whole[lo : lo + 4 * ROWS], ids[who], q[who], k, longest)
                names += ids[who][which].tolist()
                numbers += number[which].tolist()
                b += found
                s += score
        return pa.table({"query_id": pa.array(names, pa.int64()), "number": pa.array(numbers, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    found = data.groupBy("d", "block", "asked").cogroup(ask.groupBy("length", "block", "asked")).applyInArrow(run, "query_id long, number long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
