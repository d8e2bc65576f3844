"""Nearest neighbours by collision counting over single-projection hash arrays.

Vectors are dealt into blocks. In a block every random projection is one sorted array. A query opens a
window around its own projection in each array; the windows widen with a virtual radius, so the arrays
are hashed anew at every radius without being built anew, and a vector that falls into enough windows
at a radius is verified by its true distance. Widening ends when the k-th verified distance is within
the radius, or every vector of the block has been verified. The best k of all blocks are the result.

The threshold and the first radius come from the block's own data: for a few of its vectors the true
neighbours are found by a plain scan, and the threshold is the number of collisions that all but a few
per cent of them reach when the radius is the k-th distance.

Queries are a stated set that meets all rows. A block's index is built once and queries are streamed
past it, so a task holds one block and a batch of queries; only where there are fewer blocks than cores
are the queries of a block dealt among several tasks. Vectors of different dimension never meet.

Edge cases: vectors that are null, zero, or hold a null or non-finite component, and rows without an
id, take no part; equal distances go to the smaller id; a query never finds a row with its own id;
rows that repeat an id count as one candidate, the nearest; fewer candidates than k are all returned;
distances of very large or small components are scaled, so that squares neither overflow nor vanish;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000
PROJECTIONS = 128
REACH = 1.0  # half-width of a window in radii
TARGET = 0.88  # share of true neighbours that the threshold lets through at their own radius; widening beyond it finds more
SCHEMA = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    gap = vectors - query
    most = np.abs(gap).max(axis=1, initial=0.0)
    if ((most < 1e-140) & (most > 0) | (most > 1e140)).any():
        scale = np.where(most > 0, most, 1.0)
        return np.sqrt(((gap / scale[:, None]) ** 2).sum(axis=1)) * scale
    return np.sqrt((gap**2).sum(axis=1))


class CollisionIndex:
    """The sorted projection arrays of one block of vectors, for searches of the ``k`` nearest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = 10, projections: int = PROJECTIONS, reach: float = REACH, target: float = TARGET, sample: int = 48, seed: int = 11):
        self.ids, self.vectors, self.k, self.reach = ids, vectors, k, reach
        self.scale = float(np.abs(vectors).max(initial=0.0)) or 1.0  # hashing works on vectors of this size or less
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections)) / np.sqrt(vectors.shape[1])
        values = (vectors / self.scale) @ self.axes
        order = np.argsort(values, axis=0, kind="stable").T
        self.values = np.take_along_axis(values, order.T, axis=0).T
        # all arrays behind each other, far enough apart that one search serves every projection
        self.limit = 2 * float(np.abs(values).max(initial=0.0)) + 0.5
        self.shift = np.arange(projections) * (2 * self.limit)
        self.flat = (self.values + self.shift[:, None]).ravel()
        self.starts = np.arange(projections) * len(ids)
        self.flat_order = np.ascontiguousarray(order.ravel())
        self.verified = 0
        self._calibrate(values, sample, target)

    def _calibrate(self, values: np.ndarray, sample: int, target: float) -> None:
        """Set the threshold and the first radius; radii are of scaled vectors, as projections see them."""
        n = len(self.ids)
        asked = np.unique(np.linspace(0, n - 1, min(sample, n)).astype(np.int64))
        counts, radii = [], []
        for q in asked.tolist():
            d = distances(self.vectors, self.vectors[q]) / self.scale
            d[self.ids == self.ids[q]] = np.inf
            near = np.argpartition(d, min(self.k, n) - 1)[: self.k]
            near = near[np.isfinite(d[near])]
            if len(near) and d[near].max() > 0:
                radii.append(d[near].max())
                half = self.reach * radii[-1] / np.sqrt(self.vectors.shape[1])
                counts.append((np.abs(values[near] - values[q]) <= half).sum(axis=1))
        self.threshold = max(1, int(np.quantile(np.concatenate(counts), 1 - target))) if counts else 1
        self.first = 0.9 * min(radii) if radii else 1e-6

    def search(self, query_id: int, query: np.ndarray, growth: float = 1.06) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest found and their distances."""
        n, k = len(self.ids), self.k
        width = np.sqrt(len(query))
        centre = np.clip((query / self.scale) @ self.axes, -self.limit / 2, self.limit / 2) + self.shift
        counts = np.zeros(n, dtype=np.int32)
        fresh_ones = np.ones(n, dtype=bool)  # not verified yet
        found, distance = np.zeros(0, dtype=np.int64), np.zeros(0)
        low = np.clip(np.searchsorted(self.flat, centre), self.starts, self.starts + n)
        high = low.copy()
        radius, order = self.first, self.flat_order
        while True:
            half = min(self.reach * radius / width, self.limit)
            a = np.clip(np.searchsorted(self.flat, centre - half), self.starts, low)
            b = np.clip(np.searchsorted(self.flat, centre + half, side="right"), high, self.starts + n)
            entered = [order[x:y] for x, y in zip([*a.tolist(), *high.tolist()], [*low.tolist(), *b.tolist()]) if x < y]
            low, high = a, b
            if entered:
                counts += np.bincount(np.concatenate(entered), minlength=n).astype(np.int32)
            fresh = np.flatnonzero((counts >= self.threshold) & fresh_ones)
            if len(fresh):
                fresh_ones[fresh] = False
                self.verified += len(fresh)
                fresh = fresh[self.ids[fresh] != query_id]
                found = np.concatenate([found, fresh])
                distance = np.concatenate([distance, distances(self.vectors[fresh], query)])
                best = np.lexsort((self.ids[found], distance))
                _, first = np.unique(self.ids[found[best]], return_index=True)
                best = best[np.sort(first)][:k]
                found, distance = found[best], distance[best]
            if len(found) >= k and distance[k - 1] <= radius * self.scale or not fresh_ones.any():
                return self.ids[found], distance
            radius *= growth


def _matrix(values: pa.ListArray) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``vectors`` found for each row of ``queries``."""
    spark = vectors.sparkSession

    def rows(df: DataFrame) -> DataFrame:
        picked = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
        return picked.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("dim", F.size("embedding"))

    every, asked = rows(vectors), rows(queries)
    n, n_queries = every.count(), asked.count()
    blocks = max(1, -(-n // block_rows))
    # where there are fewer blocks than cores, the queries of a block are dealt among as many tasks as that leaves
    parts = max(1, min(-(-spark.sparkContext.defaultParallelism // blocks), -(-n_queries // 32)))
    upto = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    left = every.select("dim", block.alias("block"), upto(parts).alias("part"), F.lit(False).alias("asks"), "vec_id", "embedding")
    right = asked.select("dim", upto(blocks).alias("block"), part.alias("part"), F.lit(True).alias("asks"), "vec_id", "embedding")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, index = None, [], [], None
        for batch in batches:
            rows = [batch[c].to_numpy(zero_copy_only=False) for c in ("dim", "block", "part", "asks", "vec_id")]
            if not batch.num_rows:
                continue
            of = np.stack([r.astype(np.int64) for r in rows[:4]])
            cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if key != of[:3, a].tolist():
                    key, ids, held, index = of[:3, a].tolist(), [], [], None
                matrix = _matrix(batch["embedding"].slice(a, b - a))
                if not of[3, a]:
                    ids.append(rows[4][a:b])
                    held.append(matrix)
                elif ids:
                    if index is None:
                        index = CollisionIndex(np.concatenate(ids), np.concatenate(held), k)
                        held = []
                    found = [(q, *index.search(q, query)) for q, query in zip(rows[4][a:b].tolist(), matrix)]
                    size = [len(f[1]) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], size), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]), pa.float64())],
                        names=["query_id", "vec_id", "score"],
                    )

    both = left.unionByName(right)
    number = F.col("block") * parts + F.col("part")
    near = both.repartitionById(blocks * parts, number).sortWithinPartitions("dim", "block", "part", "asks").mapInArrow(meet, SCHEMA)
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, sample: DataFrame, k: int = 10, most: int = 200) -> float:
    """Share of the true ``k`` nearest of the queries in ``sample`` that ``found`` has; of more than ``most`` queries, each of which meets every vector, those of the smallest hashes are taken."""
    picked = sample.where(usable(F.col("embedding"))).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).orderBy(F.xxhash64("query_id"), "query_id").limit(most)
    pairs = vectors.where(usable(F.col("embedding"))).join(F.broadcast(picked), F.col("vec_id") != F.col("query_id"))
    gap = F.aggregate(F.zip_with("embedding", "query", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "vec_id"))
    true = pairs.select("query_id", "vec_id", gap.alias("gap")).withColumn("nth", nth).where(F.col("nth") <= k)
    hits, total = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return hits / total if total else 1.0
