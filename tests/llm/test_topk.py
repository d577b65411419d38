"""Bounds and results against all pairs."""

import numpy as np
import pytest

import __spark_entry__ as entry
import check
from assayer.llm import topk


def test_bounds_hold_and_sharpen():
    rng = np.random.default_rng(1)
    q, x = rng.integers(-60, 60, (40, 37)).astype(float), rng.integers(-60, 60, (50, 37)).astype(float)
    score = q @ x.T
    slack = []
    for s in (1, 4, 16, 64):
        bound = topk.statistics(q, s) @ topk.statistics(x, s).T
        assert (bound >= score - 1e-6).all()
        slack.append((bound - score).mean())
    assert slack == sorted(slack, reverse=True) and slack[-1] < 1e-6


def brute(rows, k, every):
    ok = [(i, tuple(int(np.floor(64 * float(c))) for c in v)) for i, v in rows
          if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i in sorted({i for i, _ in ok if i % every == 0}):
        w = min(v for j, v in ok if j == i)
        near = sorted((-sum(a * b for a, b in zip(w, v)), j) for j, v in ok if j != i and len(v) == len(w))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_rows(spark, monkeypatch, block):
    """Ties, copies, odd vectors, repeated ids, several lengths, blocks of all sizes."""
    for name, size in (("BLOCK", block), ("QUERY_BLOCK", 5), ("TILE", 2), ("GROUP", 2)):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(block)
    rows = [(i, [float(c) for c in rng.normal(0, .2, 6).astype(np.float32)]) for i in range(150)]
    rows += [(i, [0.25] * 6) for i in range(150, 220)] + [(i, [0.5, 0.1]) for i in range(220, 232)]
    rows += [(240, None), (260, [None, 1.0]), (280, [float("nan")] * 6), (300, [float("inf")] + [0.0] * 5), (320, []), (321, []),
             (None, [0.25] * 6), (160, [0.9] * 6), (160, [0.25] * 6), (20, rows[20][1]), (340, [1e6] * 6), (341, [-3e6] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows, 20, 20)
    assert topk.top_k(df.limit(0)).count() == 0


def test_query(spark, data):
    assert check.compare(spark, check.connect(data), data, "op6_segment_topk",
                         entry.oracle_sql()["op6_segment_topk"]).startswith("ok")
