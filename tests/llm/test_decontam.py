"""The word search against plain substring search."""

import random
import re

import pytest

import __spark_entry__ as entry
import check
from assayer.llm import decontam

PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(t):
    return PLAIN.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(text, items, window):
    w = plain_words(text)
    hit, names = set(), set()
    for item, t in items:
        p = plain_words(t)
        n = min(window, len(p))
        for i in range(len(p) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == p[i:i + n]:
                    hit.update(range(j, j + n))
                    names |= {item} - {None}
    return len(w), len(hit), sorted(names)


def spans_of(hits):
    return [k for a, b in zip(hits[::2], hits[1::2]) for k in range(a, b)]


@pytest.mark.parametrize("window", [1, 2, 3, 5, 13])
def test_scan_equals_brute_force(window):
    rnd = random.Random(window)
    word = lambda: rnd.choice(["a", "b", "c", "Éa", "x9", "d"])
    items = [(str(i % 20), " ".join(word() for _ in range(rnd.randint(0, 12)))) for i in range(25)] + [(None, "a b c d")]
    texts = [" - ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "...", "a " * 3000 + items[3][1] + " b" * 3000]
    out = decontam.Matcher(items, window).scan(texts, [([], [])] * len(texts))
    for t, n_words, n_hit, spans, names in zip(texts, out.n_words, out.n_hit, out.spans, out["items"]):
        assert (n_words, n_hit, names) == brute(t, items, window)
        assert len(spans_of(spans)) == n_hit


def test_rows_and_shards(spark):
    items = [(1, "one two three four"), (1, "five six"), (None, "seven eight"), (3, None), (4, ""), (5, "nine")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [None, "", "One, two three FOUR!", "five six seven eight nine", "five six seven eight nine", "none here",
             "x " * 30_000 + "nine"]
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, hits string")
    want = [(i, *brute(t, [(None if k is None else str(k), x) for k, x in items], 13)) for i, t in enumerate(texts)]
    for size in (10, 10 ** 6):  # several shards, one shard
        out = decontam.with_hits(docs, bench, shard_chars=size).collect()
        got = [(r.doc_id, r.hits.n_words, r.hits.n_hit, r.hits["items"]) for r in out]
        assert sorted(got) == sorted(want)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 5, 6}
    assert decontam.report(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontam.report(docs, bench.limit(0)).collect()} == {0}


def test_query(spark, data):
    assert check.compare(spark, check.connect(data), data, "op7_wu_manber",
                         entry.oracle_sql()["op7_wu_manber"]).startswith("ok")
