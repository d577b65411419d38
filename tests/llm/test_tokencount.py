"""Counts against a public unigram implementation and against plain search."""

import math
import random

import public_tokenizers
import pytest
import regex
from tokenizers import models

import __spark_entry__ as entry
from assayer.llm import bpe, tokencount
from assayer.llm.queries import MULTI_RANKS

PATH = public_tokenizers.path(MULTI_RANKS)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


def plain(word, ranks, longest):
    """(score, count) by the textbook forward pass, without a trie."""
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        best.append(min((best[a][0] + tokencount.weight(ranks[word[a:end]]), best[a][1] + 1)
                        for a in range(max(0, end - longest), end) if word[a:end] in ranks))
    return best[-1]


def test_against_plain_search_and_public_model(ranks, monkeypatch):
    monkeypatch.setattr(tokencount, "NODES", 300)
    monkeypatch.setattr(tokencount, "LONG", 40)
    trie, rnd, longest = tokencount.Trie(ranks), random.Random(1), max(map(len, ranks))
    vocab = [(k.decode("latin-1"), -tokencount.weight(r) / 1e6) for k, r in ranks.items()]
    model = models.Unigram(vocab, 0)
    for _ in range(400):
        w = " " * rnd.randint(0, 1) + "".join(rnd.choice(["th", "e", "r", "ing", "ß", "日", "1", "tion", "x"])
                                              for _ in range(rnd.randint(1, 25)))
        v = trie.insert(w.encode())
        got = v >> 40, v & (1 << 40) - 1
        assert got == plain(w.encode(), ranks, longest)
        tokens = model.tokenize(w.encode().decode("latin-1"))
        score = -sum(tokencount.weight(ranks[t.value.encode("latin-1")]) for t in tokens)
        assert math.isclose(score, -got[0], abs_tol=5)


def test_rows(spark, ranks):
    texts = [None, "", "a", "a", "the other thing\n\n\tß日\U0001F600 12345", "x" * 3000, "then there " * 20_000]
    docs = spark.createDataFrame([(i % 6 or None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    vocab = bpe.vocabulary(spark, PATH)
    out = tokencount.count_tokens(docs, vocab, public_tokenizers.PATTERN)
    longest, want = max(map(len, ranks)), []
    for i, t in enumerate(texts):
        words = regex.findall(public_tokenizers.PATTERN, t or "")
        each = {w: plain(w.encode(), ranks, longest) for w in set(words)}
        want.append((str(i % 6 or None), len(words), sum(each[w][1] for w in words), -sum(each[w][0] for w in words) / 1e6))
    assert sorted((str(r.doc_id), *r[1:]) for r in out.collect()) == sorted(want)
    assert tokencount.count_tokens(docs.limit(0), vocab, public_tokenizers.PATTERN).count() == 0


def test_query(spark, data, ranks):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    longest, memo, want = max(map(len, ranks)), {}, {}
    for d in docs:
        n = 0
        for w in regex.findall(public_tokenizers.PATTERN, d.text or ""):
            if w not in memo:
                memo[w] = plain(w.encode(), ranks, longest)[1]
            n += memo[w]
        want[d.doc_id] = n
    assert {r.doc_id: r.n_tokens for r in entry.queries()["op9_trie_counts"](spark, data).collect()} == want


def test_large_ids_beside_null(spark, ranks):
    docs = spark.createDataFrame([((1 << 60) + 1, "a"), ((1 << 60) + 3, "b c"), (None, "d")], "doc_id long, text string")
    out = tokencount.count_tokens(docs.coalesce(1), bpe.vocabulary(spark, PATH), public_tokenizers.PATTERN)
    assert out.schema["doc_id"].dataType.simpleString() == "bigint"
    assert {r.doc_id for r in out.collect()} == {(1 << 60) + 1, (1 << 60) + 3, None}
