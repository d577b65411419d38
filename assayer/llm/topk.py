"""Exact top-k by inner product with multi-resolution segment statistics.

Components become whole numbers, floor(64 x).  A vector is cut into segments, at
first one and then ever more; a segment is known by its mean and its deviation.
For two vectors these give a lower bound of their distance,

    d(q, x)^2 >= sum over segments of  size (mean_q - mean_x)^2 + (dev_q - dev_x)^2,

and with d^2 = |q|^2 + |x|^2 - 2 qx an upper bound of their inner product.
Bounds are taken from coarse to fine, each only where the one before lets a
candidate into the k best so far; what is left is computed exactly in integers.

The query set meets all rows in blocks: tasks pack rows into blocks of bounded
size, each pair of a query block and a group of candidate blocks is one unit of
work that carries the k best from block to block, and a ranking over the units'
results ends it.  Only the names of blocks are broadcast.

Rows: vectors that are null or hold null or non-finite components take no part,
neither do rows without an id.  Vectors meet only those of their own length.  A
query id on several rows is one query, with the smallest of its vectors; as
candidates all rows count, except those with the query's own id.  Fewer
candidates than k: all of them.  Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import written

SCALE = 64
EVERY = 20
K = 20
QUERY_BLOCK, BLOCK, GROUP, TILE = 2048, 4096, 16, 256
SEGMENTS = (1, 4, 16)
_BLOCK = "dim int, unit string, ids binary, data binary, width int"


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(table: DataFrame, vector: str) -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & finite)


def pack(rows: DataFrame, size: int, group: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length, up to ``group`` blocks a unit."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), {}
        held: dict[int, list] = {}

        def block(dim):
            own = sorted(held.pop(dim), key=lambda r: r[0])
            data = np.array([v for _, v in own], dtype=np.int64).reshape(len(own), dim)
            top = int(np.abs(data).max(initial=0))
            width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
            n = made[dim] = made.get(dim, -1) + 1
            return pd.DataFrame({"dim": [dim], "unit": [f"{part}-{n // group}"], "width": [width],
                                 "ids": [np.array([i for i, _ in own], dtype=np.int64).tobytes()],
                                 "data": [data.astype(f"<i{width}").tobytes()]})

        for batch in batches:
            for i, v in zip(batch["vec_id"], batch["v"]):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return rows.select("vec_id", "v").mapInPandas(run, _BLOCK)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means (times the root of the size) and deviations of the segments of each row: the
    bound of an inner product is the inner product of these."""
    cuts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    out = []
    for c in cuts:
        if len(c):
            mean = x[:, c].mean(axis=1)
            out += [mean * np.sqrt(len(c)), np.sqrt(np.maximum(0, (x[:, c] ** 2).sum(axis=1) - len(c) * mean ** 2))]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers; in doubles where these hold them exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most >= 2 ** 63:
        raise OverflowError("inner products beyond 64 bits")
    return q @ x.T


class Best:
    """The k best of each query of a tile so far: score falling, then id rising."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.limit = np.full(len(q), np.iinfo(np.int64).min)
        self.found = np.empty((3, 0), dtype=np.int64)  # query, id, score
        self.levels = [statistics(q.astype(np.float64), s) for s in SEGMENTS]

    def meet(self, ids: np.ndarray, x: np.ndarray, levels: list[np.ndarray]) -> None:
        rows, cols = np.arange(len(self.q)), np.arange(len(x))
        if (self.limit > np.iinfo(np.int64).min).all():
            for own, other in zip(self.levels, levels):
                # rounding of the bound is far below one, a score is a whole number
                on = own[rows] @ other[cols].T + 0.5 >= self.limit[rows][:, None]
                rows, cols = rows[on.any(axis=1)], cols[on.any(axis=0)]
                if not len(rows):
                    return
        score = exact(self.q[rows], x[cols])
        own = ids[cols][None, :] == self.ids[rows][:, None]
        if len(cols) > 4 * self.k:  # what is below the k best of this block alone can't stay
            ranked = np.where(own, np.iinfo(np.int64).min, score)
            kth = np.partition(ranked, len(cols) - self.k, axis=1)[:, len(cols) - self.k]
        else:
            kth = np.full(len(rows), np.iinfo(np.int64).min)
        r, c = np.nonzero(~own & (score >= np.maximum(kth, self.limit[rows])[:, None]))
        found = np.concatenate([self.found, np.stack([rows[r], ids[cols[c]], score[r, c]])], axis=1)
        found = found[:, np.lexsort((found[1], -found[2], found[0]))]
        first = np.searchsorted(found[0], found[0])
        self.found = found = found[:, np.arange(found.shape[1]) - first < self.k]
        count = np.bincount(found[0], minlength=len(self.q))
        last = np.cumsum(count) - 1
        full = count == self.k
        self.limit[full] = found[2, last[full]]


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, dtype=np.int64)
    return ids, np.frombuffer(row.data, dtype=f"<i{row.width}").reshape(len(ids), row.dim).astype(np.int64)


def top_k(rows: DataFrame, vector: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each id divisible by ``every``."""
    sound = usable(rows.select("vec_id", vector), vector).select("vec_id", whole_numbers(F.col(vector)).alias("v"))
    asked = sound.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = written(pack(asked, QUERY_BLOCK, 1), "queries")
    blocks = written(pack(sound, BLOCK, GROUP), "blocks")
    # the names of units are a few bytes for tens of thousands of vectors
    asks = queries.select(F.col("dim").alias("d"), F.col("unit").alias("q")).distinct()
    has = blocks.select(F.col("dim").alias("d"), F.col("unit").alias("c")).distinct()
    left = queries.withColumnRenamed("unit", "q").join(F.broadcast(has), F.col("dim") == F.col("d")).drop("d")
    right = blocks.withColumnRenamed("unit", "c").join(F.broadcast(asks), F.col("dim") == F.col("d")).drop("d")

    def search(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty((3, 0), dtype=np.int64)]
        tiles = []
        for row in mine.itertuples():
            ids, q = _unpack(row)
            tiles += [Best(ids[i:i + TILE], q[i:i + TILE], k) for i in range(0, len(ids), TILE)]
        for row in others.itertuples():
            ids, x = _unpack(row)
            levels = [statistics(x.astype(np.float64), s) for s in SEGMENTS]
            for tile in tiles:
                tile.meet(ids, x, levels)
        for tile in tiles:
            out.append(np.stack([tile.ids[tile.found[0]], tile.found[1], tile.found[2]]))
        query, vec, score = np.concatenate(out, axis=1)
        return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})

    keys = ("dim", "q", "c")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     q AS (SELECT vec_id AS query_id, min(v) AS w FROM e WHERE vec_id % {EVERY} = 0 GROUP BY vec_id),
     s AS (SELECT query_id, vec_id, coalesce(list_sum(list_transform(list_zip(v, w), lambda p: p[1] * p[2])), 0)::BIGINT AS score
           FROM q JOIN e ON len(v) = len(w) AND vec_id <> query_id),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
                  vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
