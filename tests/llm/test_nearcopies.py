"""Near copies against the similarity of all pairs."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_simhash import classes

import corpus_pipeline
from assayer.llm import nearcopies, simhash
from assayer.llm.common import BATCH_BYTES, small_batches


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept(docs):
    of = {i: plain(t) for i, t in docs}
    root = classes(sorted(of), lambda x, y: similar(of[x], of[y]))
    return sorted(i for i in root if root[i] == i)


def test_rows(spark):
    texts = [(5, "a b c d"), (3, "A B  c d"), (3, "A B  c d"), (None, "a b c d"), (9, None), (8, ""), (7, "alone here"),
             (None, "only null id here"), (None, "only null id here")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, key int")
    got = nearcopies.representatives(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [3, 7, 8, None]
    assert nearcopies.representatives(docs.limit(0)).count() == 0


@pytest.mark.parametrize("often", [1, 10**9])
def test_planted(spark, monkeypatch, often):
    """The pipeline's stage on near copies of texts of all lengths, chains and a repeated line."""
    monkeypatch.setattr(nearcopies, "SAMPLED", 1)
    monkeypatch.setattr(nearcopies, "OFTEN", often)
    rnd = random.Random(often)
    words = [f"w{i}" for i in range(3000)]
    line, docs = " ".join(rnd.choices(words, k=30)), []
    for size in (1, 4, 6, 30, 60, 120, 400):
        for _ in range(4):
            text = rnd.choices(words, k=size)
            for _ in range(5):
                docs.append((len(docs), " ".join(text)))
                text = list(text)
                for _ in range(rnd.randint(0, max(1, size // 40))):
                    text[rnd.randrange(size)] = rnd.choice(words)
    docs += [(len(docs) + i, f"{line} {rnd.choice(words)} " + " ".join(rnd.choices(words, k=i))) for i in range(30)]
    docs += [(len(docs) + i, f"{line} " * 9 + " ".join(rnd.choices(words, k=60))) for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = kept(docs)
    assert len(want) < len(docs) - 60
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()) == want


def test_stage_on_given_documents(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, data).collect()) == kept(docs)


def test_sketches_bound_the_difference():
    rnd = random.Random(1)
    for _ in range(200):
        words = [str(rnd.randrange(500)) for _ in range(rnd.randint(1, 300))]
        other = [w if rnd.random() < 0.97 else "x" for w in words] + words[:rnd.randint(0, 90)]
        a, b = nearcopies.shingles(" ".join(words)), nearcopies.shingles(" ".join(other))
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert nearcopies.differing(nearcopies.sketch(a), nearcopies.sketch(b)) <= apart
        assert nearcopies.differing(nearcopies.sketch(a), nearcopies.sketch(a)) == 0


def test_template_is_no_key(spark, monkeypatch):
    """Texts of one template that are not similar are no candidates of each other."""
    rnd = random.Random(4)
    template = " ".join(f"t{i}" for i in range(30))
    docs = [(i, template + "".join(f" u{rnd.randrange(10 ** 9)}" for _ in range(5))) for i in range(1500)]
    tried = []
    real = nearcopies._similar
    monkeypatch.setattr(nearcopies, "SAMPLED", 4)
    monkeypatch.setattr(nearcopies, "_similar", lambda pairs, *rest: (tried.append(pairs.count()), real(pairs, *rest))[1])
    got = nearcopies.representatives(spark.createDataFrame(docs, "doc_id long, text string")).count()
    assert got == 1500 and sum(tried) <= 1500


def test_small_batches_bound_what_a_task_holds(spark):
    df = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('x', 10000) AS text")

    @F.pandas_udf("int")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    before = spark.conf.get(BATCH_BYTES)
    with small_batches(spark, "100k"):
        rows = df.select(held("text").alias("n")).collect()
    assert len(rows) == 400 and max(r.n for r in rows) <= 20
    assert spark.conf.get(BATCH_BYTES) == before


def test_texts_meet_their_simhash_component(spark, data, monkeypatch):
    """The stage holds every text against the first of its component by SimHash of five words."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(300)
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: simhash.fingerprint(t, nearcopies.SHINGLE) for i, t in texts.items()}
    want = classes(sorted(prints), lambda x, y: ((prints[x] ^ prints[y]) & (2 ** 64 - 1)).bit_count() <= 3)
    sets = spark.createDataFrame(sorted(prints.items()), "sid long, fp long")
    got = {tuple(r) for r in nearcopies.by_fingerprint(sets).collect()}
    assert len(got) == sum(i != r for i, r in want.items()) > 0
    assert all(want[a] == a and want[b] == a for a, b in got)
    met, real = [], nearcopies.by_fingerprint
    monkeypatch.setattr(nearcopies, "by_fingerprint", lambda sets: (met.append(sets.count()), real(sets))[1])
    nearcopies.representatives(docs)
    assert len(met) == 1 and met[0] > 0


def test_copies_with_too_many_changes(spark, monkeypatch):
    """Copies of one text that are not similar to each other don't meet in pairs; similar ones are found."""
    rnd = random.Random(7)
    template, docs = [f"t{i}" for i in range(150)], []
    for i in range(300):
        words = list(template)
        for at in rnd.sample(range(150), rnd.randint(2, 4)):
            words[at] = f"u{rnd.randrange(10 ** 9)}"
        docs.append(words)
        if i % 10 == 0:
            docs.append(words[:75] + ["more"] + words[75:])
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    tried, real = [], nearcopies._similar
    monkeypatch.setattr(nearcopies, "SAMPLED", 1)
    monkeypatch.setattr(nearcopies, "_similar", lambda pairs, *rest: (tried.append(pairs.count()), real(pairs, *rest))[1])
    got = nearcopies.representatives(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == kept(docs)
    assert sum(tried) <= 12 * len(docs)


@pytest.mark.parametrize("often", [1, 10**9])
def test_planted_by_differences(spark, monkeypatch, often):
    monkeypatch.setattr(nearcopies, "LARGE", 0)
    met, real = [], nearcopies.by_difference
    monkeypatch.setattr(nearcopies, "by_difference", lambda groups, *rest: (met.append(groups.count()), real(groups, *rest))[1])
    test_planted(spark, monkeypatch, often)
    assert met and met[0] > 0
