"""Fingerprints, links and components against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assayer.llm import simhash
from assayer.llm.components import components


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def classes(values, linked):
    """Smallest value reachable, by plain search."""
    root = {}
    for v in sorted(values):
        if v in root:
            continue
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = v
                todo += [y for y in values if y not in root and linked(x, y)]
    return root


def test_spark_hash_is_the_same():
    assert signed(plain_print("a")) == simhash.fingerprint("A")
    for t in (None, "", "  \t\n", "A b", "a b\x0bc\xa0d", "x" * 100 + " É é", "one two three four five " * 40):
        assert simhash.fingerprint(t) == signed(plain_print(t))
    long = " ".join(random.Random(1).choice("abcdefgh") for _ in range(70_000))
    assert simhash.fingerprint(long) == signed(plain_print(long))


@pytest.mark.parametrize("bucket", [2, 10, 10_000])
def test_links_equal_all_pairs(spark, bucket):
    """Dense neighbourhoods, so that keys hold many and are refined."""
    rnd, values = random.Random(bucket), {0, -1}
    for _ in range(6):
        base = rnd.getrandbits(64)
        soft = rnd.sample(range(64), 8)
        for _ in range(50):
            v = base
            for b in rnd.sample(soft, rnd.randint(0, 4)):
                v ^= 1 << b
            values.add(signed(v))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for bits in (1, 3):
        got = sorted(tuple(r) for r in simhash.links(df, bits, bucket).collect())
        want = sorted((a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= bits)
        assert got == want


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)]
    edges += [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 900)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    df = spark.createDataFrame([*edges, (None, 3), (1000, None)], "s long, t long")
    got = {r.node: r.root for r in components(df, "s", "t").collect()}
    assert got == classes(list(near), lambda x, y: y in near[x])
    assert components(df.limit(0), "s", "t").count() == 0


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)  # no fingerprint is often, some are, all are
    texts = [(5, "a b c d"), (3, "A B  c d"), (3, "A B  c d"), (None, "a b c d"), (9, None), (8, ""), (7, "alone here"),
             (None, "only null id here"), (None, "only null id here")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.report(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 7), (None, None), (None, None)], key=str)
    assert simhash.report(docs.limit(0)).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, 8, None]


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    of = {d.doc_id: plain_print(d.text) for d in docs}
    root = classes(sorted(of), lambda x, y: bin(of[x] ^ of[y]).count("1") <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op4_simhash"](spark, data).collect()}
    assert got == {d: (f"{of[d]:016x}", root[d]) for d in of}
