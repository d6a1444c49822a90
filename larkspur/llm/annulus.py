"""Centroid clustering in integers, with annulus search for the nearest centroid.

Centroids are sorted by norm. A vector x has some centroid at a distance u, so its nearest one has a norm within u of the norm
of x, by the triangle inequality: two binary searches bound those candidates, ties on the boundary with them, and integer
distances decide among them. u is the least distance to a few centroids whose norms are next to that of x.

A pass over the vectors reads the input itself, with the centroids (k x dim integers) broadcast; a task gives back
one row of sums for each cluster that it has met, so a cluster of any size is summed before anything is
shuffled. Nothing is written or cached between the passes, and a lost executor costs its own tasks only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import integers, products

#: Centroids next in norm from which the upper bound is taken.
PILOTS = 8
#: Vectors of neighbouring norms that are searched together.
CHUNK = 512


class Annuli:
    """Centroids (k x dim integers) sorted by norm, in which nearest ones are searched."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids * centroids).sum(axis=1)
        self.number = np.argsort(squares, kind="stable")
        self.centroids, self.squares = centroids[self.number], squares[self.number]
        self.norms = np.sqrt(self.squares.astype(np.float64))

    def annulus(self, norms: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of places (start, end) of the centroids whose norms are within ``bound`` of ``norms``.

        Norms are rounded, so the range is wider by more than their error: a candidate too many is compared exactly.
        """
        slack = (norms + bound) * 1e-12 + 1e-9
        return np.searchsorted(self.norms, norms - bound - slack, "left"), np.searchsorted(self.norms, norms + bound + slack, "right")

    def _distances(self, x: np.ndarray, squares: np.ndarray, start: int, end: int) -> np.ndarray:
        return squares[:, None] - 2 * products(x, self.centroids[start:end]) + self.squares[start:end]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row of ``x`` and their squared distance; ties go to the smaller number."""
        squares = (x * x).sum(axis=1)
        norms, k = np.sqrt(squares.astype(np.float64)), len(self.norms)
        cluster, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        by_norm = np.argsort(norms, kind="stable")
        for at in range(0, len(x), CHUNK):
            rows = by_norm[at : at + CHUNK]
            first = int(np.clip(np.searchsorted(self.norms, norms[rows[len(rows) // 2]]) - PILOTS // 2, 0, max(0, k - PILOTS)))
            pilots = self._distances(x[rows], squares[rows], first, first + PILOTS)
            start, end = self.annulus(norms[rows], np.sqrt(pilots.min(axis=1).astype(np.float64)))
            low, high = int(start.min()), int(end.max())
            found, place = self._distances(x[rows], squares[rows], low, high), np.arange(low, high)
            outside = (place < start[:, None]) | (place >= end[:, None])
            found[outside] = np.iinfo(np.int64).max
            best = found.min(axis=1)
            cluster[rows] = np.where(found == best[:, None], self.number[low:high], k).min(axis=1)
            distance[rows] = best
        return cluster, distance


def first_centroids(vectors: DataFrame, k: int, seed: str, id_col: str, vector_col: str, dim: int) -> np.ndarray:
    """The k usable vectors with the smallest sha256 of ``seed:id``, in the order of these; equal ids by their components, null ids last."""

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(1), dim)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], ["id", "x"])

    rows = vectors.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{vector_col}`").alias("x"))
    kept = rows.mapInArrow(usable, "id string, x array<long>")
    drawn = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256).asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in drawn], np.int64).reshape(len(drawn), dim)


def _sums(vectors: DataFrame, centroids: np.ndarray, vector_col: str) -> list:
    """(cluster, n, inertia, s0, s1, ...) of each cluster that is not empty; k rows at most."""
    dim, shared = centroids.shape[1], vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Annuli(shared.value), len(shared.value)
        n, inertia, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            _, x = integers(batch.column(0), dim)
            cluster, distance = search.nearest(x)
            n += np.bincount(cluster, minlength=k)
            np.add.at(inertia, cluster, distance)
            order = np.argsort(cluster, kind="stable")
            met, starts = np.unique(cluster[order], return_index=True)
            if len(met):
                total[met] += np.add.reduceat(x[order], starts, axis=0)
        met = np.flatnonzero(n)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total[met].ravel()), dim).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), pa.array(inertia[met]), lists], ["cluster", "n", "inertia", "sums"])

    partial = vectors.select(F.col(f"`{vector_col}`").alias("x")).mapInArrow(run, "cluster int, n long, inertia long, sums array<long>")
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *each).collect()


def fit(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64) -> np.ndarray:
    """The centroids (k x dim integers; fewer rows where fewer vectors are usable) after ``rounds`` rounds.

    A round moves each centroid to the floor of the mean of its vectors, by exact integers; one without vectors stays. Sums
    beyond 63 bits raise Spark's overflow error.
    """
    centroids = first_centroids(vectors, k, seed, id_col, vector_col, dim)
    for _ in range(rounds if len(centroids) else 0):
        for r in _sums(vectors, centroids, vector_col):
            centroids[r.cluster] = np.array(r[3:], np.int64) // r.n  # floors, below zero too
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance): the nearest centroid of every usable vector and the squared distance to it."""
    dim, shared = centroids.shape[1], vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(shared.value)
        for batch in batches:
            rows, x = integers(batch.column(1), dim)
            cluster, distance = search.nearest(x)
            columns = [batch.column(0).take(pa.array(rows)), pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("x"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")
    return found.withColumnRenamed("id", id_col)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid) of every usable vector after ``rounds`` rounds of k-means.

    A null vector, one of another length than ``dim`` and one with a null, NaN or infinite component give no row. Repeated rows stay
    repeated and count each time; a null id keeps its row; other columns play no part; an empty table gives no rows. Equal
    vectors may start as several centroids, of which the first gets all ties.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    centroids = fit(vectors, k, rounds, seed, id_col, vector_col, dim)
    if not len(centroids):
        empty = T.StructType([T.StructField(id_col, kind)])
        added = (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid", T.ArrayType(T.LongType())))
        for name, of in added:
            empty = empty.add(name, of)
        return spark.createDataFrame([], empty)
    held = [(r.cluster, r.inertia) for r in _sums(vectors, centroids, vector_col)]
    total = sum(inertia for _, inertia in held)
    rows = [(c, inertia, total, centroids[c].tolist()) for c, inertia in held]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")  # k rows at most
    found = assign(vectors, centroids, id_col, vector_col).join(F.broadcast(each), "cluster")
    return found.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")
