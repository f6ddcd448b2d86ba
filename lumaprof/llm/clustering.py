"""Centroid clustering whose lower bounds are loosened by geometry, not by full drift.

Every vector keeps its cluster and a lower bound on its distance to all other
centroids. When centroid j moves from a to b, a vector x comes nearer to it by
d(x, a) - d(x, b) at most, which is less than the drift |a - b| unless x lies on the
ray behind b. In the plane through a, b and the centre of the vector's cluster, the
points that come nearer by more than p * cos(angle), p being the drift, lie inside
of a hyperbola whose asymptotes leave the midpoint of a and b at that angle. So the
angle under which the cluster's sphere (its old centroid and farthest vector) first
meets a ray from the midpoint bounds the loss for all its vectors at once; the
greatest such loss over the other centroids loosens their lower bounds. Vectors
whose own distance is then still below the bound, or below half the way to the
nearest other centroid, keep their cluster; all others are ambiguous and are
scanned against every centroid.

Rounds are passes over one table (vectors, clusters, bounds) that is written to the
shared folder; the table before it is removed once the next one is whole. Only per
cluster figures (count, sums, radius) go to the driver: k rows a round.

Kept are vectors with exactly ``dimension`` components, none of them null or
non-finite. A null ``vec_id`` is clustered like any other, but never starts a
centroid before others; equal ids start by the order of their vectors. Repeated rows
count each. With fewer vectors than k there are as many centroids as vectors; an
empty table gives no row. Distances are exact below 2**63, greater ones are cut to
it. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaprof.llm.common import removed, shared_path, written
from lumaprof.llm.topk import matrix

#: Components up to this keep all products and sums of squares of 64 exact in doubles.
SMALL = 1 << 22
#: Relative slack that covers the rounding of distances and angles.
SLACK = 1e-9
#: Vectors of a batch that are scanned at a time.
TILE = 4096
STATE = "vec_id bigint, v array<bigint>, cluster int, distance bigint, lower double, scanned boolean"


def whole_numbers(vectors: DataFrame, scale: int, dimension: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors that are kept."""
    x = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    kept = x.filter(F.size("x") == dimension).filter(
        "not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    # Far beyond any distance that is still exact, components are cut so that floor() fits a long.
    most = float(1 << 60)
    return kept.select("vec_id", F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(most)), F.lit(-most)))).alias("v"))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much at most any other centroid came nearer to the vectors of each cluster (its sphere about its old centroid)."""
    k = len(old)
    drift = np.sqrt(((new - old) ** 2).sum(1))
    loss = np.zeros((k, k))
    for j in np.flatnonzero(drift > 0):
        axis = (new[j] - old[j]) / drift[j]
        reach = old - (old[j] + new[j]) / 2
        far = np.sqrt((reach ** 2).sum(1))
        outside = far > radius * (1 + SLACK)
        far = np.where(far > 0, far, 1)
        angle = np.arccos(np.clip(reach @ axis / far, -1, 1)) - np.arcsin(np.clip(radius / far, 0, 1))
        # Beyond a right angle the sphere lies on the old side, where nothing comes nearer.
        nearer = drift[j] * np.cos(np.clip(angle - SLACK, 0, np.pi / 2))
        loss[:, j] = np.where(outside, nearer, drift[j])
    np.fill_diagonal(loss, 0)
    return loss.max(axis=1, initial=0)


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half of each centroid's distance to its nearest other one."""
    square = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(square, np.inf)
    return np.sqrt(square.min(axis=1, initial=np.inf)) / 2


def _exact(rows: list[list[int]], centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance in whole numbers of any size."""
    square = [[sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids] for row in rows]
    best = [min(range(len(s)), key=lambda n: (s[n], n)) for s in square]
    return np.array(best), np.array([min(s[b], 2 ** 63 - 1) for s, b in zip(square, best)])


def _assigned(state: DataFrame, centroids: list[list[int]], loss: np.ndarray | None) -> DataFrame:
    """One pass: bounds are loosened by ``loss``, and vectors that they do not settle are scanned (all of them where it is None)."""
    small = max((abs(c) for row in centroids for c in row), default=0) <= SMALL
    points = np.array(centroids, dtype=np.float64)
    gaps = half_gaps(points)
    squares = (points ** 2).sum(1)

    def one_tile(v: np.ndarray, cluster: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        distance = np.zeros(len(v))
        open_rows = np.ones(len(v), bool)
        if loss is not None:
            lower = lower - loss[cluster]
            distance = ((v - points[cluster]) ** 2).sum(1)
            open_rows = np.sqrt(distance) * (1 + SLACK) >= np.maximum(lower, gaps[cluster]) * (1 - SLACK)
        if open_rows.any():
            some = v[open_rows]
            all_squares = (some ** 2).sum(1)[:, None] + squares[None, :] - 2 * some @ points.T
            nearest = all_squares.argmin(axis=1)
            cluster, lower = cluster.copy(), lower.copy()
            cluster[open_rows] = nearest
            distance[open_rows] = all_squares[np.arange(len(some)), nearest]
            all_squares[np.arange(len(some)), nearest] = np.inf
            lower[open_rows] = np.sqrt(all_squares.min(axis=1)) * (1 - SLACK)
        return cluster, distance.astype(np.int64), lower, open_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                part = batch.slice(start, TILE)
                v = matrix(part.column("v"), part.num_rows)
                if small and np.abs(v).max(initial=0) <= SMALL:
                    found = one_tile(v, part.column("cluster").to_numpy().astype(np.int64), part.column("lower").to_numpy())
                else:  # beyond doubles: no bounds, every vector scanned
                    nearest, square = _exact(part.column("v").to_pylist(), centroids)
                    found = nearest, square, np.full(len(v), -np.inf), np.ones(len(v), bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("v"), pa.array(found[0].astype(np.int32)), pa.array(found[1].astype(np.int64)),
                     pa.array(found[2]), pa.array(found[3])], ["vec_id", "v", "cluster", "distance", "lower", "scanned"])

    return state.mapInArrow(run, STATE)


def starts(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the least SHA-256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in rows.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()]


def moved(state: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], np.ndarray]:
    """Componentwise floor(sum / count) of every cluster (empty ones stay), and each cluster's radius; one row per cluster is read."""
    sums = [F.sum(F.col("v")[n].cast("decimal(38,0)")).alias(f"s{n}") for n in range(len(centroids[0]))]
    out, radius = [list(c) for c in centroids], np.zeros(len(centroids))
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect():
        out[row["cluster"]] = [int(row[f"s{n}"]) // row["n"] for n in range(len(centroids[0]))]
        radius[row["cluster"]] = np.sqrt(float(row["far"])) * (1 + SLACK)
    return out, radius


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, list[list[int]]]:
    """The state of all vectors (vec_id, v) after the last assignment, and the centroids they are assigned to.

    ``scanned`` tells which vectors the bounds did not settle in that last pass.
    """
    spark = vectors.sparkSession
    path = shared_path(spark, "vectors")
    base = written(vectors.withColumn("cluster", F.lit(0)).withColumn("lower", F.lit(0.0)), "vectors", path=path)
    centroids = starts(base, k, seed)
    if not centroids:
        return base.selectExpr("vec_id", "v", "cluster", "0L as distance", "lower", "true as scanned"), []
    state, loss = base, None
    for turn in range(rounds + 1):
        before, path = path, shared_path(spark, "clusters")
        state = written(_assigned(state, centroids, loss), "clusters", path=path)
        removed(spark, before)
        if turn < rounds:
            old = centroids
            centroids, radius = moved(state, old)
            loss = loosening(np.array(old, dtype=np.float64), np.array(centroids, dtype=np.float64), radius)
    return state, centroids


def summarised(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dimension: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    state, centroids = clustered(whole_numbers(vectors, scale, dimension), k, rounds, seed)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part")).collect()  # k rows
    inertia = sum(int(r["part"]) for r in sums)
    most = 2 ** 63 - 1
    figures = vectors.sparkSession.createDataFrame(
        [(r["cluster"], min(int(r["part"]), most), min(inertia, most), digests[r["cluster"]]) for r in sums],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.join(F.broadcast(figures), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
