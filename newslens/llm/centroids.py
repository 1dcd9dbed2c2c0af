"""Centroid clustering (Lloyd's rounds) with an equal-average equal-variance search for the nearest centroid.

Vectors become integers, floor(SCALE * x), so that sums, distances and ties are exact. For a vector x with component sum S(x)
and deviation V(x) - the length of x minus its mean - d times the squared distance of x and c is at least
(S(x) - S(c))^2 + d * (V(x) - V(c))^2. The search sorts the centroids by their mean and goes outward from a vector's own mean,
the nearer side first. Where the mean alone puts a centroid beyond the best so far, its whole side is done; where mean and
deviation do, the centroid is passed over. The rest are compared in integers; of equal distances the smaller number wins, so
only a bound strictly above the best rejects. The bounds are kept a little low, against rounding. All vectors of an Arrow batch
take their steps together.

The start is a bounded list (one row for each centroid). In every round each task adds up its vectors by centroid and sends one
row for each centroid and component; Spark sums them, and k * d sums come to the driver. The vectors are staged once, as
integers, and never move after that.

Cases: vectors with another number of components, with null or non-finite components, and null vectors are left out; a
component beyond +-COMPONENT_LIMIT after scaling counts as that limit, so that a distance fits a long; sums of distances that
don't fit a long become its greatest value; fewer vectors than centroids give fewer centroids; equal vectors share a cluster,
and repeated or null ids are rows of their own (a null id is an empty text in the starting hash, equal hashes are ordered by
the components); an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import stage

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
COMPONENT_LIMIT = 1 << 27
_LOW = 1 - 1e-9
_MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, x array<int>) of the vectors that have all their components, finite."""
    x = F.col(vector_col)
    sound = (F.size(x) == dimensions) & F.forall(x, lambda v: F.coalesce((F.abs(v.cast("double")) < float("inf")), F.lit(False)) & ~F.isnan(v.cast("double")))
    bounded = F.transform(x, lambda v: F.least(F.greatest(F.floor(F.least(F.greatest(v.cast("double"), F.lit(-2.0**31)), F.lit(2.0**31)) * scale), F.lit(-COMPONENT_LIMIT)), F.lit(COMPONENT_LIMIT)).cast("int"))
    return vectors.select(F.col(id_col).alias("id"), x.alias(vector_col)).where(x.isNotNull() & sound).select("id", bounded.alias("x"))


def start(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The components of the rows whose ids have the smallest SHA-256 with the seed."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(key.alias("key"), "x").orderBy("key", "x").limit(clusters).collect()
    return np.array([r.x for r in first], np.int64).reshape(len(first), len(first[0].x) if first else 0)


class Search:
    """Centroids in the order of their means."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(1)
        self.number = np.argsort(sums, kind="stable")
        self.centroids = centroids[self.number]
        self.sums = sums[self.number].astype(np.float64)
        self.deviations = _deviations(self.centroids)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row of x, and the squared distance."""
        n, d = x.shape
        k = len(self.number)
        sums, deviations = x.sum(1).astype(np.float64), _deviations(x)
        best, winner = np.full(n, _MOST, np.int64), np.full(n, k, np.int64)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        todo = np.arange(n)
        while len(todo):
            u, l = up[todo], down[todo]
            rise = np.where(u < k, self.sums[np.minimum(u, k - 1)] - sums[todo], np.inf)
            fall = np.where(l >= 0, sums[todo] - self.sums[np.maximum(l, 0)], np.inf)
            upward = rise <= fall
            gap = np.where(upward, rise, fall)
            bound = d * best[todo].astype(np.float64)
            # the nearer side is beyond the best, so the other is as well
            open_ = (gap < np.inf) & (gap * gap * _LOW <= bound)
            todo, upward, gap, bound = todo[open_], upward[open_], gap[open_], bound[open_]
            if not len(todo):
                break
            at = np.where(upward, up[todo], down[todo])
            up[todo[upward]] += 1
            down[todo[~upward]] -= 1
            spread = deviations[todo] - self.deviations[at]
            near = (gap * gap + d * spread * spread) * _LOW <= bound
            rows, at = todo[near], at[near]
            if len(rows):
                delta = x[rows] - self.centroids[at]
                distance = np.einsum("ij,ij->i", delta, delta)
                better = (distance < best[rows]) | ((distance == best[rows]) & (self.number[at] < winner[rows]))
                best[rows[better]], winner[rows[better]] = distance[better], self.number[at[better]]
        return winner, best


def _deviations(x: np.ndarray) -> np.ndarray:
    """The length of each row minus its mean."""
    y = x.astype(np.float64)
    y -= y.mean(1, keepdims=True)
    return np.sqrt(np.einsum("ij,ij->i", y, y))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _sums(centroids: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        k, d = centroids.shape
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                winner, _ = search.nearest(x)
                np.add.at(total, winner, x)
                count += np.bincount(winner, minlength=k)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, d), pa.int32()), pa.array(np.tile(np.arange(d), len(used)), pa.int32()), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], d))],
                names=["cluster", "component", "total", "n"])

    return sums


def lloyd(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds; a mean is rounded down, an empty cluster keeps its centroid."""
    for _ in range(rounds if len(centroids) else 0):
        found = rows.select("x").mapInArrow(_sums(centroids), "cluster int, component int, total long, n long")
        summed = found.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # clusters * dimensions
        after = centroids.copy()
        for r in summed:
            after[r.cluster, r.component] = r.total // r.n
        if np.array_equal(after, centroids):
            break  # no later round would change anything
        centroids = after
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of each row."""
    kind = rows.schema["id"].dataType.simpleString()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            if batch.num_rows:
                winner, distance = search.nearest(_matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(winner, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    return rows.mapInArrow(assigned, f"id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each sound vector, and the final centroids."""
    rows = stage(quantised(vectors, id_col, vector_col, dimensions, scale), "vectors")
    centroids = lloyd(rows, start(rows, clusters, seed), rounds)
    return assign(rows, centroids), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row of ``assigned``."""
    spark = assigned.sparkSession
    held = stage(assigned, "assigned")
    sums = held.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row for each centroid
    total = min(_MOST, int(sum(r.d for r in sums)))
    table = [(r.cluster, min(_MOST, int(r.d)), total, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    fit = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return held.withColumnRenamed("id", id_col).join(F.broadcast(fit), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
