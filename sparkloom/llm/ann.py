"""Nearest neighbours by collision counting over single projections.

Each block of vectors keeps, for every random projection, its values in one sorted array.  A query's window stands
around its own projection and widens with the radius (virtual rehashing: no second table); a
vector that falls into the windows of at least a share ENOUGH of the projections is verified by its true
distance.  The radius grows until as many verified vectors as asked for lie inside it; a window that has come
to cover the whole block has verified every row of it, so short blocks and odd distances end exactly.

The queries are taken in blocks of QUERY_BLOCK, each broadcast alone; the vectors are never exchanged, only each
block's nearest.  Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without an id.  Rows with a query's own id are never its neighbours; of repeated
query ids one vector asks.  Ties go to the smaller id.  Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, ENOUGH, WIDTH, GROWTH = 40, 0.675, 2.719, 1.2
BLOCK, QUERY_BLOCK = 16_384, 4_096
SEED = 11


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components present and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


class Projected:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.lines = np.random.default_rng(SEED).standard_normal((rows.shape[1], PROJECTIONS))
        values = (rows @ self.lines).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, axis=1)
        self.need = int(np.ceil(ENOUGH * PROJECTIONS))

    def distances(self, some: np.ndarray, query: np.ndarray) -> np.ndarray:
        return np.sqrt(np.square(self.rows[some] - query).sum(axis=1))

    def nearest(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest found, by distance, then id."""
        n = len(self.ids)
        spread = self.distances(np.arange(0, n, max(1, n // 64)), query)
        radius = max(float(spread.min()) * 0.6, float(spread.max()) * 1e-6, 1e-300)
        at = query @ self.lines
        low = np.array([np.searchsorted(s, v) for s, v in zip(self.sorted, at, strict=True)])
        high, hits = low.copy(), np.zeros(n, np.int64)
        ids, far = np.empty(0, np.int64), np.empty(0)
        taken = np.zeros(n, bool)
        while True:
            half = WIDTH * radius / 2
            new: list[np.ndarray] = []
            for j in range(PROJECTIONS):
                a, b = np.searchsorted(self.sorted[j], (at[j] - half, at[j] + half), side="left")
                b = np.searchsorted(self.sorted[j], at[j] + half, side="right")
                a, b = min(a, low[j]), max(b, high[j])
                new += (self.order[j, a : low[j]], self.order[j, high[j] : b])
                low[j], high[j] = a, b
            hits += np.bincount(np.concatenate(new), minlength=n)
            fresh = np.flatnonzero((hits >= self.need) & ~taken)
            taken[fresh] = True
            other = fresh[self.ids[fresh] != own]
            ids, far = np.concatenate([ids, self.ids[other]]), np.concatenate([far, self.distances(other, query)])
            if taken.all() or np.count_nonzero(far <= radius) >= k:
                best = np.lexsort((ids, far))[:k]
                return ids[best], far[best]
            radius *= GROWTH


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries among vectors."""
    spark = vectors.sparkSession
    slim = lambda df: df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    every, asked = slim(vectors), slim(queries).groupBy("id").agg(F.min("v").alias("v"))
    blocks = -(-asked.count() // query_block)
    found: DataFrame | None = None
    for b in range(max(1, blocks)):
        # a bounded block: what is collected and broadcast doesn't grow with the tables
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))) == b).collect()
        sent = spark.sparkContext.broadcast([(r.id, np.array(r.v)) for r in rows])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids: list[np.ndarray] = []
            parts: list[np.ndarray] = []

            def done() -> pa.RecordBatch:
                out: list[tuple[np.ndarray, ...]] = []
                all_ids = np.concatenate(ids)
                sizes = np.concatenate([np.full(len(p), p.shape[1]) for p in parts])
                for size in np.unique(sizes):
                    index = Projected(all_ids[sizes == size], np.concatenate([p for p in parts if p.shape[1] == size]))
                    for own, query in sent.value:
                        if len(query) == size:
                            near, far = index.nearest(own, query, k)
                            out.append((np.full(len(near), own), near, far))
                columns = [np.concatenate([o[i] for o in out]) if out else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
                return pa.record_batch([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

            held = 0
            for batch in batches:
                lengths = np.diff(batch.column(1).offsets.to_numpy())
                flat, own = batch.column(1).flatten().to_numpy(), batch.column(0).to_numpy()
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.empty(0, int)
                for size in np.unique(lengths):
                    rows_of = np.flatnonzero(lengths == size)
                    ids.append(own[rows_of])
                    parts.append(flat[starts[rows_of][:, None] + np.arange(size)])
                held += len(lengths)
                if held >= block:
                    yield done()
                    ids, parts, held = [], [], 0
            if held:
                yield done()

        some = every.mapInArrow(search, "query_id long, vec_id long, score double")
        found = some if found is None else found.unionByName(some)
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
