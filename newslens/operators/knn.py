"""Exact k-nearest-neighbour join without a cross join.

Plan:

1. The queries of a group are dealt into blocks by a hash of their id: so many that all cores have work, and at least so
   many that no block exceeds ``block`` rows. A block is the state of one task: its vectors and the best k of each so far.
2. Every reference row goes to all blocks of its group, one plain row for each, and is sorted behind the block's queries in
   the order of the ids. A task reads that stream batch by batch (``mapInArrow``) and never holds more than the block and
   one batch, however many rows there are.
3. Of a batch, one matrix product screens all pairs against the k-th distance found so far; only pairs that may be among the
   best k (with a margin for rounding) are measured, by differences, and merged. Once every query has k, they are screened in
   groups of queries that lie together, without the rows whose distance from a group's bounds exceeds all its k-th. As ids ascend, a later row loses every
   tie, so rows with equal vectors cost the screening only.

The result equals brute force ordered by (distance rounded to 6 places, id). The work is that of all pairs, a product of
matrices; what is shuffled is the reference rows times the number of blocks.

Distances run in Euclidean space: raw vectors for ``metric="euclidean"``,
L2-normalised vectors for ``metric="cosine"`` (where ||a-b||^2 = 2 - 2 cos);
the reported ``dist`` is 1 - cos or the Euclidean distance.

Cases: rows without an id, a vector or (with ``group_col``) a group have no neighbours and are none; a vector with a
component that is not finite is no neighbour either; rows that share an id share one list of k.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens.session import ensure_checkpoint_dir, materialize

#: Half a unit of the 6th place, by which a distance may round down.
HALF_PLACE = 0.5e-6
#: Query blocks for each core, so that tasks even out.
BLOCKS_PER_CORE = 3
#: Pairs that are screened, and pairs that are measured at once.
SCREENED, MEASURED = 1 << 21, 1 << 17
#: Queries of a group, the components that bound it, and the rows of a batch from which groups are worth while.
GROUP, WIDEST, MANY = 32, 8, 1024


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # the norm as a variable: named in the inner lambda, it would be computed for every component
    return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))), 0)


def _prep(df: DataFrame, id_col: str, vec_col: str, metric: str, group_col: str | None) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    if metric == "cosine":
        v = l2_normalise(v)
    g = F.col(group_col).cast("bigint") if group_col else F.lit(0).cast("bigint")
    return df.select(F.col(id_col).cast("bigint").alias("_id"), v.alias("_v"), g.alias("_g"))


def _mat(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in col]) if len(col) else np.zeros((0, 0))


def _sq_to(V: np.ndarray, P: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances (expansion form, clipped at 0) - for bounds and screening only."""
    s = (V * V).sum(1)[:, None] + (P * P).sum(1)[None, :] - 2.0 * V @ P.T
    return np.maximum(s, 0.0)


def _matrix(col: pa.ListArray) -> np.ndarray:
    """Arrays of doubles of one length as a matrix; null components are NaN."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) % len(col) or len(pc.unique(pc.list_value_length(col))) > 1:
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(col), -1)


def _together(V: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows in groups of GROUP (the last may be smaller) that lie together: halved along the component that varies most."""
    if len(rows) <= GROUP:
        return [rows]
    part = V[rows]
    rows = rows[np.argsort(part[:, np.argmax(part.var(0))], kind="stable")]
    half = -(-len(rows) // GROUP) // 2 * GROUP
    return _together(V, rows[:half]) + _together(V, rows[half:])


class _Block:
    """The queries of one block and the best k of each among the rows seen so far, which come in the order of their ids."""

    def __init__(self, k: int, metric: str, drop_self: bool, within: np.ndarray | None = None):
        """``within``: a distance of each query (in the order asked) that no neighbour of it needs to exceed."""
        self.k, self.cosine, self.drop_self, self.within = k, metric == "cosine", drop_self, within
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids = None

    def ask(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.parts.append((ids, vectors))

    def _close(self) -> None:
        self.ids = np.concatenate([i for i, _ in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.V = np.concatenate([v for _, v in self.parts]) if self.parts else np.zeros((0, 0))
        self.norm, self.wide = (self.V * self.V).sum(1), None
        if len(self.ids) > GROUP and self.V.shape[1] and np.isfinite(self.norm).all():
            self.wide = np.argsort(-self.V.var(0), kind="stable")[:WIDEST]
            order = np.concatenate(_together(self.V[:, self.wide], np.arange(len(self.ids))))
            self.ids, self.V, self.norm = self.ids[order], self.V[order], self.norm[order]
            self.within = None if self.within is None else self.within[order]
            bounds, starts = self.V[:, self.wide], np.arange(0, len(order), GROUP)
            self.low, self.high = np.minimum.reduceat(bounds, starts), np.maximum.reduceat(bounds, starts)
        self.best = np.full((len(self.ids), self.k), np.inf)
        self.near = np.zeros((len(self.ids), self.k), np.int64)
        self.parts = []

    def _limit(self, dist: np.ndarray) -> np.ndarray:
        """Squared distances up to which a row may be at most ``dist`` away."""
        return np.where(dist < 0, -np.inf, 2.0 * dist if self.cosine else dist * np.abs(dist))

    def see(self, ids: np.ndarray, R: np.ndarray) -> None:
        if self.ids is None:
            self._close()
        if not len(self.ids):
            return
        square = (R * R).sum(1)
        ok = np.isfinite(square)
        if not ok.all():
            ids, R, square = ids[ok], R[ok], square[ok]
        if not len(ids):
            return
        grouped = self.wide is not None and len(ids) >= MANY and bool(np.isfinite(self.best[:, -1]).all())
        step = GROUP if grouped else max(1, SCREENED // len(ids))
        every, wide = (ids, R, square), np.ascontiguousarray(R[:, self.wide]) if grouped else None
        most = square.max()
        for at in range(0, len(self.ids), step):
            rows = np.arange(at, min(at + step, len(self.ids)))
            Q = self.V[rows]
            # the error of the expanded squares
            slack = 1e-12 * (1.0 + R.shape[1] * (self.norm[rows] + most))
            # a later id loses ties: the rounded distance has to be smaller
            lim = self._limit(np.round(self.best[rows, -1], 6) - HALF_PLACE + 1e-9) + slack
            if self.within is not None:
                lim = np.minimum(lim, self._limit(np.round(self.within[rows], 6) + HALF_PLACE + 1e-9) + slack)
            if grouped:
                gap = np.maximum(self.low[at // GROUP] - wide, wide - self.high[at // GROUP])
                np.maximum(gap, 0.0, out=gap)
                some = np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= lim.max())
                if not len(some):
                    continue
                ids, R, square = every if 2 * len(some) > len(wide) else tuple(x[some] for x in every)
            S = Q @ R.T
            S *= -2.0
            S += square
            S += self.norm[rows][:, None]
            hit = S <= lim[:, None]
            if len(ids) > self.k and np.count_nonzero(hit) > 4 * self.k * len(rows):
                # many may be near: no more than the k-th of this batch are
                if self.drop_self:
                    S[self.ids[rows][:, None] == ids[None, :]] = np.inf
                kth = np.maximum(np.partition(S, self.k - 1, axis=1)[:, self.k - 1], 0.0) + slack
                upto = self._limit((kth / 2.0 if self.cosine else np.sqrt(kth)) + 2 * HALF_PLACE + 1e-9) + slack
                hit = S <= np.minimum(lim, np.where(np.isfinite(kth), upto, np.inf))[:, None]
                hit &= np.isfinite(S)
            i, j = np.nonzero(hit)
            # whole queries at a time
            ends = np.searchsorted(i, np.arange(len(rows) + 1))
            a = 0
            while a < len(rows):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + MEASURED, side="right")) - 1)
                if ends[b] > ends[a]:
                    self._merge(rows[i[ends[a]:ends[b]]], j[ends[a]:ends[b]], ids, R)
                a = b

    def _merge(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, R: np.ndarray) -> None:
        if self.drop_self:
            other = self.ids[i] != ids[j]
            i, j = i[other], j[other]
        dist = np.empty(len(i))
        for at in range(0, len(i), MEASURED):
            diff = R[j[at:at + MEASURED]] - self.V[i[at:at + MEASURED]]
            dist[at:at + MEASURED] = (diff * diff).sum(1)
        dist = dist / 2.0 if self.cosine else np.sqrt(dist)
        some = np.unique(i)
        had = np.isfinite(self.best[some])
        row = np.concatenate([some[np.nonzero(had)[0]], i])
        near = np.concatenate([self.near[some][had], ids[j]])
        dist = np.concatenate([self.best[some][had], dist])
        order = np.lexsort((near, np.round(dist, 6), row))
        row, near, dist = row[order], near[order], dist[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < self.k
        self.best[row[top], place[top]] = dist[top]
        self.near[row[top], place[top]] = near[top]

    def answers(self):
        if self.ids is None:
            self._close()
        step = max(1, 100_000 // self.k)
        for at in range(0, len(self.ids), step):
            row, col = np.nonzero(np.isfinite(self.best[at:at + step]))
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[at:at + step][row]), pa.array(self.near[at:at + step][row, col]),
                                                  pa.array(self.best[at:at + step][row, col])], ["qid", "nn_id", "dist"])


def _search(k: int, metric: str, drop_self: bool):
    """mapInArrow body over (_g, qb, member, _id, _v), sorted: the queries of each block, then the rows they are compared with."""

    def run(batches):
        key, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, qb, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            ids = batch.column(3).to_numpy()
            cut = np.flatnonzero((g[1:] != g[:-1]) | (qb[1:] != qb[:-1]) | (member[1:] != member[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows]):
                if key != (g[a], qb[a]):
                    if block is not None:
                        yield from block.answers()
                    key, block = (g[a], qb[a]), _Block(k, metric, drop_self)
                (block.see if member[a] else block.ask)(ids[a:b], _matrix(batch.column(4).slice(a, b - a)))
        if block is not None:
            yield from block.answers()

    return run


def knn(queries: DataFrame, refs: DataFrame | None = None, k: int = 30, id_col: str = "id",
        vec_col: str = "vec", metric: str = "cosine", group_col: str | None = None,
        exclude_self: bool = True, cell_size: int = 512, block: int = 1 << 15, seed: int = 42) -> DataFrame:
    """(qid, rank, nn_id, dist) with rank 1..k.

    ``group_col`` restricts neighbours to the query's own group (same class).
    Ties are ordered by (round(dist, 6), nn_id). A block has ``cell_size`` queries at least, if there are as many, and
    ``block`` at most.
    """
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    same = refs is None
    whole = F.col("_id").isNotNull() & F.col("_v").isNotNull() & F.col("_g").isNotNull()
    # read by the counts and the search
    q = materialize(_prep(queries, id_col, vec_col, metric, group_col).filter(whole))
    r = q if same else _prep(refs, id_col, vec_col, metric, group_col).filter(whole)

    n = q.count()
    cores = spark.sparkContext.defaultParallelism * BLOCKS_PER_CORE
    size = min(max(cell_size, math.ceil(n / cores)), block)
    tasks = max(1, math.ceil(n / size))
    if group_col:
        # a row for each group that asks; a block of its own at least
        parts = q.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("parts"))
        q, r = q.join(parts, "_g"), r.join(parts, "_g")
    else:
        q, r = (x.withColumn("parts", F.lit(tasks)) for x in (q, r))
    mine = F.pmod(F.xxhash64("_id", F.lit(seed)), F.col("parts")).cast("int")
    asks = q.select("_g", mine.alias("qb"), F.lit(False).alias("member"), "_id", "_v")
    seen = r.select("_g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("qb"), F.lit(True).alias("member"), "_id", "_v")
    # the blocks of a group go to tasks in turn
    task = F.pmod(F.xxhash64("_g") + F.col("qb"), F.lit(tasks)).cast("int")
    dealt = asks.unionByName(seen).repartitionById(tasks, task).sortWithinPartitions("_g", "qb", "member", "_id")
    found = dealt.mapInArrow(_search(k, metric, bool(exclude_self and same)), "qid bigint, nn_id bigint, dist double")
    w = Window.partitionBy("qid").orderBy(F.round("dist", 6), "nn_id")
    out = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select("qid", F.col("rank").cast("bigint").alias("rank"), "nn_id", "dist")
