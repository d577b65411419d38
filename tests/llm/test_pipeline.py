"""Every stage against brute force on its own input."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_decontam import brute
from test_nearcopies import kept

import corpus_pipeline
from assayer.llm import bpe, quality
from assayer.llm.queries import MULTI_RANKS


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """Input and result of each stage by name, both as lists of rows, and the columns of the result."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = os.path.join(tmp_path_factory.mktemp("stages"), name)
        stage(spark, docs, data).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out[name] = before.collect(), docs.collect()
        if name != "byte_bpe":
            assert docs.columns == before.columns
    return out


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontam", "byte_bpe"]


def test_quality(spark, data, stages):
    before, after = stages["quality"]
    trees = quality.train(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    scores = trees.score(np.array([quality.statistics(r.text) for r in before]))
    assert 0 < len(after) < len(before)
    assert sorted(after) == sorted(r for r, p in zip(before, scores) if p >= 0.3)


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    want = set(kept([(r.doc_id, r.text) for r in before]))
    assert 0 < len(want) < len(before)
    assert sorted(after) == sorted(r for r in before if r.doc_id in want)


def test_decontam(data, spark, stages):
    before, after = stages["decontam"]
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    found = [brute(r.text, bench, 13) for r in before]
    bad = [bool(hit) and 20 * hit >= n for n, hit, _ in found]
    assert 0 < len(after)
    assert sorted(after) == sorted(r for r, b in zip(before, bad) if not b)


def test_byte_bpe(stages):
    before, after = stages["byte_bpe"]
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(public_tokenizers.path(MULTI_RANKS)))
    ids = {r.doc_id: np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes() for r in before}
    assert {r.doc_id: r.ids for r in after} == ids and len(after) == len(before)
    assert all(r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() for r in after)
    text = {r.doc_id: (r.text or "").encode() for r in before}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id]).hexdigest() for r in after)


def test_odd_rows(spark, data):
    """Nulls, repeated rows, a column more and an empty table go through all stages."""
    spark.read.parquet(f"{data}/documents.parquet").limit(60).createOrReplaceTempView("some")
    docs = spark.sql("""
        SELECT doc_id, text, lang, source, n_chars, doc_id AS hits FROM some UNION ALL SELECT *, 1 FROM some UNION ALL
        SELECT null, null, null, null, null, null UNION ALL SELECT 9000, '', null, null, 0, 2 UNION ALL SELECT null, 'x y z', 'en', 's', 5, 3""")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            before, now = now, stage(spark, now, data)
            assert now.count() <= before.count()
        assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
