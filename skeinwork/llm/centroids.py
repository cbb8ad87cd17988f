"""Centroid clustering of vectors with Hamerly's bounds, in exact integers.

Every vector keeps, beside its cluster, one upper bound of the distance to its own centroid and one
lower bound of the distance to any other.  When centroids move, the upper bound grows by its own
centroid's drift and the lower one shrinks by the largest drift of the others.  While the upper bound
is below the lower one, or below half of the own centroid's distance to its nearest neighbour, the
vector cannot change and is not compared.  Else its own distance is taken anew, and if that does not
decide, it is compared with all centroids in exact integers.  Bounds are rounded outwards and must
differ strictly, so no rounding and no tie can decide.

Vectors and bounds are written to the shared folder each round, the round before is deleted, and only
vectors that moved are summed: the sums of a cluster are exact integers and change by what comes and
goes.  Tasks send one row per cluster they touch; the driver sees k centroids and k sums.

Edge cases: vectors with another number of components, a null or non-finite one, or one beyond
``LARGEST`` units (whose squared distances would not fit a long) are passed over; a null id comes last
among the first centroids; equal ids start in the order of their components; repeated rows are vectors
of their own; fewer vectors than clusters give fewer clusters; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.runtime import discard, materialize

#: A component's largest integer: 64 squared differences of it fit a long.
LARGEST = 1 << 27

#: Outward rounding of a bound; each step of doubles errs by far less.
UP, DOWN = 1 + 2.0**-48, 1 - 2.0**-48


def quantized(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", size: int = 64, scale: int = 1024) -> DataFrame:
    """(id, v): components as integers, floor(scale * x), of the vectors that qualify."""
    made = F.transform(column, lambda x: F.floor(x.cast("double") * float(scale)))
    # a comparison with NaN or an infinity fails before the integer is made of it
    fits = lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST / scale)
    good = vectors.filter((F.size(column) == size) & F.forall(column, lambda x: F.coalesce(fits(x), F.lit(False)) & ~F.isnan(x.cast("double"))))
    return good.select(F.col(id_column).alias("id"), F.transform(made, lambda x: x.cast("int")).alias("v"))


def starts(vectors: DataFrame, k: int, salt: str = "3:") -> np.ndarray:
    """The first centroids: the ``k`` vectors with the smallest SHA-256 of salt and id."""
    drawn = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(F.asc_nulls_last(drawn), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, size).astype(np.int64)


def _scan(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances to all centroids."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        gap = v - c
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def reassigned(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after the centroids moved, and how many vectors were scanned; ``own`` is -1 for new ones."""
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    limit = np.maximum(lower, np.where(own >= 0, half[own], 0))
    doubt = np.flatnonzero((own < 0) | ~(upper < limit))
    known = doubt[own[doubt] >= 0]
    gap = v[known] - centroids[own[known]]
    upper[known] = np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(float)) * UP
    doubt = doubt[(own[doubt] < 0) | ~(upper[doubt] < limit[doubt])]
    if len(doubt):
        far = _scan(v[doubt], centroids)
        own[doubt] = far.argmin(axis=1)  # the first of equal ones
        upper[doubt] = np.sqrt(far.min(axis=1).astype(float)) * UP
        far[np.arange(len(doubt)), own[doubt]] = np.iinfo(np.int64).max
        lower[doubt] = np.sqrt(far.min(axis=1).astype(float)) * DOWN if len(centroids) > 1 else np.inf
    return own, upper, lower, len(doubt)


def _assign(state: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """One round: bounds loosened by ``drift``, then vectors reassigned; ``was`` is the cluster before."""
    size = centroids.shape[1]
    between = np.sqrt(_scan(centroids, centroids).astype(float))
    np.fill_diagonal(between, np.inf)
    half = between.min(axis=1) / 2 * DOWN
    others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(len(drift))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, upper, lower = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("own", "upper", "lower"))
            had = own >= 0
            upper = np.where(had, (upper + drift[own]) * UP, upper)
            lower = np.where(had, np.maximum((lower - others[own]) * DOWN, 0), lower)
            now, upper, lower, _ = reassigned(_vectors(batch, size), own, upper, lower, centroids, half)
            columns = [batch.column("id"), batch.column("v"), pa.array(now), pa.array(own), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "own", "was", "upper", "lower"])

    kind = dict(state.dtypes)["id"]
    return state.select("id", "v", "own", "upper", "lower").mapInArrow(run, f"id {kind}, v array<int>, own int, was int, upper double, lower double")


def _moved(state: DataFrame, k: int, size: int) -> tuple[list[int], list[list[int]]]:
    """By how many vectors each cluster grew, and by which sums: exact, from the vectors that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            v = _vectors(batch, size)
            for column, sign in (("own", 1), ("was", -1)):
                j = batch.column(column).to_numpy()
                for c in np.unique(j[j >= 0]):
                    n[c] += sign * (j == c).sum()
                    sums[c] += sign * v[j == c].sum(axis=0)
        told = np.flatnonzero((n != 0) | (sums != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(told.astype(np.int32)), pa.array(n[told]), pa.array(sums[told].tolist(), pa.list_(pa.int64()))], ["c", "n", "s"])

    parts = state.filter("own <> was").select("v", "own", "was").mapInArrow(run, "c int, n long, s array<long>")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = parts.select("c", "n", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(wide("n").alias("n"), wide("x").alias("x")).collect()  # k * size rows
    grown, sums = [0] * k, [[0] * size for _ in range(k)]
    for r in rows:
        grown[r.c], sums[r.c][r.i] = int(r.n), int(r.x)
    return grown, sums


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector of ``vectors`` (id, v), distance squared; and the final centroids."""
    vectors = materialize(vectors, "vectors")
    centroids = starts(vectors, k, salt)
    kind = dict(vectors.dtypes)["id"]
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long"), centroids
    k, size = centroids.shape
    state = vectors.select("id", "v", F.lit(-1).alias("own"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    counts, sums, drift = [0] * k, [[0] * size for _ in range(k)], np.zeros(k)
    for turn in range(rounds + 1):
        before, state = state, materialize(_assign(state, centroids, drift), f"bounds-{turn}")
        if turn:
            discard(before)
        if turn == rounds:
            break
        grown, added = _moved(state, k, size)
        counts = [a + b for a, b in zip(counts, grown)]
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, added)]
        new = np.array([[x // n for x in row] if n else old.tolist() for row, n, old in zip(sums, counts, centroids)], np.int64)
        gap = new - centroids
        drift = np.sqrt((gap * gap).sum(axis=1).astype(float)) * UP
        centroids = new
    return _distances(state, centroids, kind), centroids


def _distances(state: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own").to_numpy()
            gap = _vectors(batch, centroids.shape[1]) - centroids[own]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(np.einsum("ij,ij->i", gap, gap))], ["id", "cluster", "distance"])

    return state.select("id", "v", "own").mapInArrow(run, f"id {kind}, cluster int, distance long")


def summary(made: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``made`` with cluster_inertia, inertia (null if beyond a long) and centroid_sha256."""
    spark = made.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    wide: Column = F.sum(F.col("distance").cast("decimal(38,0)"))
    each = made.groupBy("cluster").agg(wide.alias("w")).join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    total = made.agg(wide.alias("t"))
    told = each.crossJoin(F.broadcast(total)).select("cluster", F.col("w").try_cast("long").alias("cluster_inertia"), F.col("t").try_cast("long").alias("inertia"), "centroid_sha256")
    return made.join(F.broadcast(told), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
