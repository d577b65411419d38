"""Trees against a per-row walk; held-out accuracy; odd rows."""

import zlib

import numpy as np

import __spark_entry__ as entry
from assayer.llm import quality


def test_vectorised_walk_equals_single_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5)).round(1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    m = quality.fit(x, y, trees=25, depth=3)
    got = m.score(x)
    for row, p in zip(x[:80], got):
        total = m.base
        for feature, limit, value in zip(m.feature, m.limit, m.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += value[node - len(feature)]
        assert abs(p - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((got > 0.5) == y).mean() > 0.97


def test_no_or_one_label():
    x = np.zeros((3, 2))
    assert np.allclose(quality.fit(x[:0], np.zeros(0)).score(x), 0.5)
    assert (quality.fit(np.zeros((50, 2)), np.ones(50)).score(x) > 0.9).all()


def test_statistics_of_odd_texts():
    for t in (None, "", " ", "\n\n", "é", "x" * 300_000, "a\n" * 100_000, "\x00\x01"):
        s = quality.statistics(t)
        assert len(s) == len(quality.NAMES) and np.isfinite(s).all()
    assert quality.statistics(None) == quality.statistics("")


def test_rows(spark):
    docs = spark.createDataFrame([(i % 300 or None, ("good text here. " if i % 2 else "%%% &&& ") * (1 + i % 7) if i % 11 else None,
                                   "s") for i in range(400)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 300)] * 2 + [(None, 1), (5, None)], "doc_id long, quality int")
    out = quality.report(docs, labels).collect()
    assert len(out) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in out)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 400
    assert {r.score for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.report(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = [r for r in entry.queries()["op5_quality_trees"](spark, folder).collect() if r.held_out and r.doc_id in label]
    assert len(out) > 40 and sum(r.predicted == label[r.doc_id] for r in out) / len(out) > 0.95
