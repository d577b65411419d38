"""Whitening against whole numbers and one plain decomposition."""

import math
import random

import numpy as np
import pytest

from assayer.llm import whitening


def scaled(v, scale=256):
    return [math.floor(scale * float(c)) for c in v]


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def check_against_plain(rows, got):
    """rows: (vec_id, vector); got: the report."""
    of = [(i, scaled(v)) for i, v in rows if usable(v)]
    x = sorted({tuple(v) for _, v in of})
    n, sums = len(x), [sum(c) for c in zip(*x)]
    m = np.array(x, dtype=float)
    y = m - np.array([s / n for s in sums])
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    per: dict = {}
    for r in got:
        per.setdefault((r.vec_id, r.component), []).append(r)
    k = min(4, m.shape[1])
    assert len(got) == k * len(of)
    sign = {}
    for i, v in of:
        far = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for c in range(1, k + 1):
            want = (np.array(v) - np.array(sums) / n) @ axes[:, c - 1] / math.sqrt(values[c - 1])
            r = next(r for r in per[i, c] if r.deviation == far)
            assert r.n == n and abs(r.explained / (values[c - 1] / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-6
            assert abs(abs(r.whitened) - abs(want)) < 1e-6 * max(1, abs(want))
            if abs(want) > 1e-3:
                assert sign.setdefault(c, np.sign(r.whitened * want)) == np.sign(r.whitened * want)


def test_rows(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, s) for s in (9, 5, 2, 1, 0.5)]) for i in range(80)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(7, rows[7][1]), (None, rows[8][1])]
    bad = [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [float("nan")] * 5), (503, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad],
                               "vec_id long, embedding array<double>, x int, component int")
    got = whitening.report(df).collect()
    check_against_plain(rows, got)
    assert sum(r.vec_id is None for r in got) == 4
    assert whitening.report(df.limit(0)).count() == 0
    assert whitening.report(df.where("vec_id = 3")).count() == 0  # one distinct vector has no direction


def test_counts_as_weights(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: r.white for r in whitening.whiten(df, scale=1, weights="count").collect()}
    m = np.array([v for _, v in rows])
    cov = np.cov(m.T, bias=True)
    z = np.array([out[i].z for i, _ in rows])
    assert np.allclose(z.T @ z / 5, np.eye(2)) and np.allclose(out[0].explained, np.linalg.eigvalsh(cov)[::-1] / np.trace(cov))
    assert {w.n for w in out.values()} == {5}
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="none")


def test_lengths_and_large_numbers(spark):
    rows = [(i, [float(i), float(i * i)]) for i in range(9)] + [(20 + i, [float(1 << 40) * i]) for i in range(4)] + [(40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: r.white for r in whitening.whiten(df).collect()}
    assert set(out) == {i for i, v in rows if v}
    sums = 256 * (1 << 40) * 6
    assert [int(out[20 + i].deviation) for i in range(4)] == [(4 * 256 * (1 << 40) * i - sums) ** 2 for i in range(4)]


def test_given_vectors(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    check_against_plain([(r.vec_id, r.embedding) for r in df.collect()], whitening.report(df).collect())
