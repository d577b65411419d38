"""Whitening of embeddings with a covariance weighted by multiplicity.

Components become whole numbers: floor(``scale`` * c).  Equal vectors are grouped
first, so that a vector that fills a third of the table is one row per task; the fit
takes each distinct vector with the weight one or with its count.  Sums are exact
integers; the covariance is a weighted matrix product of centred blocks, one per
task, whose entries are added up in a shuffle (d (d + 1) / 2 rows per task).  Only the
d x d matrix reaches the driver.  Each distinct vector is whitened once and its
result joined back to the rows.  Vectors that hold more than a thousandth of the
rows, fewer than a thousand, are joined by broadcast; no row of theirs is shuffled by vector.

Rows: vectors that are null, hold null or non-finite entries or leave 63 bits when
scaled take no part and have no result.  Vectors of each length are a fit of their
own.  Directions without variance are no components, so one distinct vector,
or an empty one, has no result.  Repeated rows and ids come out as often as they come in.
A deviation that leaves 38 digits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.session import written

SCALE = 256
COMPONENTS = 4
#: A vector of more than this share (one in so many) of the rows is joined by broadcast.
HOT = 1000
BLOCK = 4096


@dataclass
class Fit:
    """What one length of vectors is whitened with."""

    n: int
    sums: list[int]
    mean: np.ndarray
    vectors: np.ndarray   # d x components
    values: np.ndarray
    explained: np.ndarray


def whole(vector: Column, scale: int = SCALE) -> Column:
    """The vector as longs, or null if it takes no part."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale)).cast("double")))
    fits = F.forall(vector, lambda c: F.coalesce(
        F.abs(c.cast("double") * F.lit(float(scale))) < F.lit(2.0 ** 63), F.lit(False)))
    return F.when(vector.isNotNull() & F.coalesce(fits, F.lit(False)), scaled)


def distinct(rows: DataFrame) -> DataFrame:
    """(x, c): every distinct vector with the number of its rows."""
    return rows.groupBy("x").agg(F.count(F.lit(1)).alias("c"))


def _stacked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of vectors of one length with their counts."""
    for batch in batches:
        size = batch["x"].map(len).to_numpy(dtype=np.int64) if len(batch) else np.zeros(0, np.int64)
        for d in np.unique(size).tolist():
            x, c = batch["x"].to_numpy()[size == d], batch["c"].to_numpy(dtype=np.int64)[size == d]
            for i in range(0, len(x), BLOCK):
                yield np.array(x[i:i + BLOCK].tolist(), dtype=np.int64).reshape(-1, d), c[i:i + BLOCK]


def _sums(vectors: DataFrame, weighted: bool) -> dict[int, tuple[int, list[int]]]:
    """Of each length: the weight and the exact sum of each dimension."""
    w = F.col("c") if weighted else F.lit(1).cast("long")
    wide = "decimal(38,0)"
    each = vectors.select(F.size("x").alias("d"), w.alias("w"), F.posexplode("x").alias("i", "v"))
    total = each.groupBy("d", "i").agg(F.sum("w").alias("n"), F.sum(F.col("v").cast(wide) * F.col("w")).alias("s")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(total, key=lambda r: (r.d, r.i)):
        found.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    return found


def fit(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one") -> dict[int, Fit]:
    """Fits by length of ``vectors`` (x, c), a written table; ``weights``: one or count."""
    if weights not in ("one", "count"):
        raise ValueError("weights: one or count")
    sums = _sums(vectors, weights == "count")
    mean = {d: np.array([s / n for s in total]) for d, (n, total) in sums.items()}

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for x, c in _stacked(batches):
            d = x.shape[1]
            y = x - mean[d]
            own[d] = own.get(d, 0) + (y.T * (c if weights == "count" else 1)) @ y
        for d, v in own.items():
            i, j = np.triu_indices(d)
            for a in range(0, len(i), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pd.DataFrame({"d": np.int32(d), "i": i[b].astype("int32"), "j": j[b].astype("int32"), "v": v[i[b], j[b]]})

    entries = vectors.where(F.size("x") > 0).mapInPandas(products, "d int, i int, j int, v double")
    table = entries.groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    fits = {}
    for d, (n, total) in sums.items():
        part, v = table[table["d"] == d], np.zeros((d, d))
        v[part["i"], part["j"]] = v[part["j"], part["i"]] = part["v"] / n
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1], axes[:, ::-1]
        real = values > d * np.finfo(float).eps * max(values[0], np.finfo(float).tiny)
        k = min(components, int(real.sum()))
        fits[d] = Fit(n, total, mean[d], axes[:, :k], values[:k], values[:k] / np.trace(v) if k else values[:0])
    return fits


def whitened(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(x, c, deviation, z) of each distinct vector: the squared distance from the mean times
    n squared, exactly, and its projections over the roots of the eigenvalues."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)

    @F.pandas_udf("deviation string, z array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far, z = [None] * len(batch), [None] * len(batch)
            size = batch.map(len).to_numpy(dtype=np.int64) if len(batch) else np.zeros(0, np.int64)
            for d in np.unique(size).tolist():
                own = shared.value.get(d)
                at = np.flatnonzero(size == d)
                for i in range(0, len(at) if own is not None else 0, BLOCK):
                    rows = at[i:i + BLOCK]
                    x = np.array(batch.to_numpy()[rows].tolist(), dtype=np.int64).reshape(-1, d)
                    most = own.n * max(1, int(np.abs(x.astype(object)).max())) + max(map(abs, own.sums))
                    if d * most * most >= 1 << 63:  # beyond 64 bits: whole numbers of any length
                        x = x.astype(object)
                    gap = own.n * x - np.array(own.sums, dtype=x.dtype)
                    score = (x.astype(np.float64) - own.mean) @ own.vectors / np.sqrt(own.values)
                    for r, a, b in zip(rows.tolist(), (gap * gap).sum(axis=1).tolist(), score.tolist()):
                        far[r], z[r] = str(a), b
            yield pd.DataFrame({"deviation": pd.Series(far, dtype=object), "z": pd.Series(z, dtype=object)})

    return vectors.withColumn("r", project("x")).select(
        "x", "c", F.expr("try_cast(r.deviation AS decimal(38,0))").alias("deviation"), "r.z")


def identity_error(scores: DataFrame, fits: dict[int, Fit], weights: str = "one") -> dict[int, float]:
    """Of each length: the largest absolute entry of the covariance of z minus the identity."""
    most = max((len(f.values) for f in fits.values()), default=0)
    w = F.col("c") if weights == "count" else F.lit(1)
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    if not pairs:
        return {}
    own = scores.select(F.size("x").alias("d"), w.alias("w"), *[F.get("z", F.lit(i)).alias(f"z{i}") for i in range(most)])
    mean = own.groupBy("d").agg(*[(F.sum(F.col("w") * F.col(f"z{i}")) / F.sum("w")).alias(f"m{i}") for i in range(most)])
    rows = own.join(F.broadcast(mean), "d").groupBy("d").agg(*[
        (F.sum(F.col("w") * (F.col(f"z{i}") - F.col(f"m{i}")) * (F.col(f"z{j}") - F.col(f"m{j}"))) / F.sum("w")).alias(
            f"v{i}_{j}") for i, j in pairs]).collect()
    return {r.d: max((abs(r[f"v{i}_{j}"] - (i == j)) for i, j in pairs if r[f"v{i}_{j}"] is not None), default=0.0)
            for r in rows}


def whiten(rows: DataFrame, *, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), scale: int = SCALE,
           components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """The columns ``keep`` of each row that takes part, with a struct ``white``: n, deviation
    (decimal), z, explained (both arrays by component) and identity_error."""
    own = rows.select(F.struct(*keep).alias("row"), whole(F.col(vector), scale).alias("x")).where("x IS NOT NULL")
    vectors = written(distinct(own), "vectors")
    fits = fit(vectors, components, weights)
    scores = written(whitened(vectors, fits), "scores")
    errors = identity_error(scores, fits, weights)
    total = vectors.agg(F.sum("c")).first()[0] or 0
    often = F.broadcast(scores.where(F.col("c") * HOT > total).drop("c"))
    seldom = scores.where(F.col("c") * HOT <= total).drop("c")
    joined = own.join(often, "x").unionByName(own.join(often.select("x"), "x", "left_anti").join(seldom, "x"))
    # one row per length of vector
    facts = F.broadcast(rows.sparkSession.createDataFrame(
        [(d, f.n, f.explained.tolist(), errors.get(d)) for d, f in fits.items()],
        "d int, n long, explained array<double>, identity_error double"))
    out = joined.withColumn("d", F.size("x")).join(facts, "d")
    return out.select("row.*", F.struct("n", "deviation", "z", "explained", "identity_error").alias("white"))


def report(rows: DataFrame) -> DataFrame:
    out = whiten(rows)
    each = out.select("vec_id", "white", F.posexplode("white.z").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "white.n",
                       F.expr("try_cast(white.deviation AS long)").alias("deviation"), "whitened",
                       F.expr("white.explained[k]").alias("explained"), "white.identity_error")
