"""Gradients, state carry and probabilities of the network; counts against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from assayer.llm import gru


@pytest.fixture()
def net():
    n = gru.Network(np.arange(gru.SYMBOLS, dtype=float))
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    n.g = {k: v.astype(np.float64) for k, v in n.g.items()}
    return n


def loss(net, x, h):
    before, _, _, _ = net.states(x, h)
    return -net.log_probability(before.astype(np.float64), x)[0].sum()


def test_gradient(net):
    """The step along the gradient, seen through the accumulators, is that of differences."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, gru.SYMBOLS, (6, 3)).astype(np.int32)
    x[2, 1] = gru.END
    h = rng.normal(0, 0.3, (3, gru.HIDDEN))
    steps = {}
    net._step = lambda name, rows, g, rate: steps.__setitem__(name, (rows, g * x.size))
    net.learn(x, h)
    for name, at in (("state", (3, 20)), ("state", (1, 2)), ("classes", (2, 5)), ("class_bias", (4,)),
                     ("members", (int(x[0, 0]) // gru.MEMBERS, 4, 7)), ("inputs", (int(x[1, 0]), 3 * gru.HIDDEN - 3))):
        rows, g = steps[name]
        got = g[at] if name != "inputs" else g[np.searchsorted(rows, at[0]), at[1]]
        p, e = net.p[name], 1e-3
        keep = p[at]
        p[at] = keep + e
        up = loss(net, x, h)
        p[at] = keep - e
        down = loss(net, x, h)
        p[at] = keep
        assert abs((up - down) / (2 * e) - got) < 2e-3 * max(1, abs(got)), name


def test_probabilities_sum_to_one(net):
    h = np.random.default_rng(1).normal(0, 0.5, (1, gru.HIDDEN))
    x = np.arange(gru.SYMBOLS, dtype=np.int32)[None, :]
    p = net.log_probability(np.repeat(h, gru.SYMBOLS, axis=0)[None], x)[0]
    assert abs(np.exp(p).sum() - 1) < 1e-6


def test_state_is_carried_over_windows():
    n, rng = gru.Network(np.ones(gru.SYMBOLS)), np.random.default_rng(2)
    n.p["inputs"] = rng.normal(0, 1, n.p["inputs"].shape).astype(np.float32)
    n.p["classes"] = rng.normal(0, 1, n.p["classes"].shape).astype(np.float32)
    docs = [np.append(rng.integers(0, gru.SYMBOLS, k), gru.END).astype(np.int32) for k in (0, 1, 3, 200, 5, 64, 63, 1000)]
    docs = [np.where(d[:-1] == gru.END, 0, d[:-1]).tolist() + [gru.END] for d in docs]
    docs = [np.array(d, dtype=np.int32) for d in docs]
    want = []
    for d in docs:
        h, total = np.zeros((1, gru.HIDDEN), np.float32), 0.0
        for s in d:
            x = np.array([[s]], dtype=np.int32)
            before, h, _, _ = n.states(x, h)
            total += float(n.log_probability(before, x)[0][0, 0])
        want.append(total / math.log(10))
    for window in (7, 64):
        assert np.allclose(gru.score_texts(n, docs, window), want, rtol=1e-4)
    assert len(gru.score_texts(n, [])) == 0


def plain(docs):
    """Counts and base scores as the contract says."""
    words = [re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for _, t in docs]
    fold = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i, _ in docs]
    c = Counter()
    for w, f in zip(words, fold):
        if f != 1:
            c.update([*w, None])
    total, kinds = sum(c.values()), len(c)
    div = math.log10(total + 0.5 * (kinds + 1))
    return [(i, f == 1, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), total,
             sum(math.log10(c[x] + 0.5) - div for x in [*w, None])) for (i, _), w, f in zip(docs, words, fold)]


def same(got, docs):
    got = sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(plain(docs), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r.base_score for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.parametrize("listed", [0, 3, 1000])
def test_rows(spark, monkeypatch, listed):
    """Nulls, empty and long texts, repeated rows; few words listed, so that the join counts the rest."""
    monkeypatch.setattr(gru, "LISTED", listed)
    monkeypatch.setattr(gru.vocabulary, "__defaults__", (listed,))
    docs = [(i, " ".join(f"w{(i * k) % 23} A{k % 3}" for k in range(i % 9))) for i in range(40)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (None, "w1 é\x0bw2"), (50, None), (51, ""), (52, "w1 " * 60_000), (1, "only here")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    same(gru.report(df).collect(), docs)
    assert gru.report(df.limit(0)).count() == 0
    held = df.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")  # nothing to learn from
    assert held.count() > 5
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in gru.report(held).collect())


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op8_gru"](spark, folder).collect()
    same(got, docs)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_gain_of_the_network():
    """One copy over sf0.01 gains what the network gains with its full size and update steps."""
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows]
    learned = [r["text"] for r, h in zip(rows, held) if not h]
    count = Counter(w for t in learned for w in gru.words_of(t))
    sums = {}
    for w, c in count.items():
        tokens, kinds = sums.get(gru.bucket(w), (0, 0))
        sums[gru.bucket(w)] = (tokens + c, kinds + 1)
    vocab = gru.Vocabulary(sorted(count.items(), key=lambda x: (-x[1], x[0])), sums, sum(count.values()) + len(learned),
                           len(count) + 1, len(learned))
    symbols = [vocab.symbols(vocab.codes(r["text"])[0]) for r, h in zip(rows, held) if h]
    net, size = gru.Network(vocab.mass), sum(map(len, symbols))
    start = gru.score_texts(net, symbols).sum() / size
    gru.train_copy(net, vocab, iter([learned]))
    assert gru.score_texts(net, symbols).sum() / size - start > 0.02


def test_large_ids_beside_null(spark):
    docs = [((1 << 60) + 1, "a"), ((1 << 60) + 3, "b c"), (None, "d")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    same(gru.report(df).collect(), docs)


def test_softmax_within_classes_goes_over_all_tokens_at_once(net, monkeypatch):
    """Only the products go class by class; probabilities are those of each class by itself."""
    rng, calls, exp = np.random.default_rng(5), [], np.exp
    before, x = rng.normal(0, 1, (7, 40, gru.HIDDEN)), rng.integers(0, gru.SYMBOLS, (7, 40)).astype(np.int32)
    monkeypatch.setattr(gru.np, "exp", lambda *a, **k: (calls.append(1), exp(*a, **k))[1])
    got = net.log_probability(before, x)[0]
    assert len(calls) == 2
    for h, s, p in zip(before.reshape(-1, gru.HIDDEN)[:50], x.ravel(), got.ravel()):
        c, m = divmod(int(s), gru.MEMBERS)
        one, two = h @ net.p["classes"] + net.p["class_bias"], h @ net.p["members"][c] + net.p["member_bias"][c]
        assert abs(one[c] - np.log(exp(one).sum()) + two[m] - np.log(exp(two).sum()) - p) < 1e-9


def test_words_of_all_texts_at_once():
    rnd = np.random.default_rng(3)
    texts = [None, "", " \t\n", "\x0b a\x0cB\x1c\x85É　x y \x1f", "\x00 \x00a", "Ä a A"]
    texts += ["".join(rnd.choice(list("aB \t\n\x0b\x0c\r\x1c\x1f\x85\xa0Ä\x00"), 25)) for _ in range(300)]
    words, sizes = gru.words_of_all(texts)
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts for w in gru.words_of(t)]
    assert sizes.tolist() == [len(gru.words_of(t)) for t in texts]
    listed = [(b"a", 9), ("ä".encode(), 3), (b"\x00", 2)]
    vocab = gru.Vocabulary(listed, {b: (20, 9) for b in range(gru.BUCKETS)}, 20, 9, 4)
    numbers = {w: i for i, (w, _) in enumerate(listed)}
    for text, (codes, rare) in zip(texts, vocab.codes_of_all(texts), strict=True):
        own = gru.words_of(text)
        assert codes.tolist() == [numbers.get(w, -1 - gru.bucket(w)) for w in own] + [len(listed)]
        assert rare == [w for w in own if w not in numbers]
    assert vocab.codes_of_all([]) == []


def test_scores_do_not_depend_on_lanes(monkeypatch):
    rnd = np.random.default_rng(5)
    net = gru.Network(rnd.random(gru.SYMBOLS))
    symbols = [np.append(rnd.integers(gru.END + 1, gru.SYMBOLS, n), gru.END).astype(np.int32) for n in rnd.integers(0, 90, 50)]
    want = gru.score_texts(net, symbols)
    monkeypatch.setattr(gru, "SCORE_LANES", 3)
    assert np.allclose(gru.score_texts(net, symbols, 7), want, atol=1e-4)
