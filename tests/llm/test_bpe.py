"""The transducer against the public library that defines the encoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
from assayer.llm import bpe, common
from assayer.llm.queries import MULTI_RANKS

PATH = public_tokenizers.path(MULTI_RANKS)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def machine(ranks):
    return bpe.Transducer(ranks)


def test_random_pieces(machine, library):
    rnd = random.Random(7)
    for _ in range(3000):
        t = "".join(rnd.choice("aaabcth e'söß日ń 12.\U0001F600") for _ in range(rnd.randint(1, 30))).encode()
        assert machine.encode(t) == library._encode_single_piece(t)


def test_long_piece_and_forgetting(machine, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_STATES", 50)
    monkeypatch.setattr(bpe, "LOOKAHEAD", 200)
    rnd = random.Random(3)
    t = "".join(rnd.choice("abcdeth") for _ in range(5000)).encode()
    assert machine.encode(t) == library._encode_single_piece(t)
    machine.forget()


def test_ranks_that_merges_do_not_reach():
    """A token that no merge makes is used only where it is a whole piece."""
    ranks = {bytes((b,)): b for b in range(256)} | {b"ab": 256, b"xyz": 257, b"abc": 258}
    m, lib = bpe.Transducer(ranks), tiktoken.Encoding("x", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for t in ("xyz", "xyzx", "abcxyz", "ababc", "aabcc"):
        assert m.encode(t.encode()) == lib.encode_ordinary(t)


def test_streaming_decode_cuts_anywhere(ranks):
    decoder, rnd = bpe.Decoder(ranks), random.Random(5)
    for _ in range(500):
        ids = np.array([rnd.randrange(256) if rnd.random() < .5 else rnd.randrange(50_256) for _ in range(20)])
        want = b"".join(decoder.data[i] for i in ids).decode("utf-8", "replace")
        for cut in (1, 3, 20):
            assert "".join(decoder.stream(ids[i:i + cut] for i in range(0, 20, cut))) == want
    assert "".join(decoder.stream([])) == ""


def test_rows(spark, library):
    """Nulls, empty and very long texts, repeated rows, an extra column named like the result."""
    texts = [None, "", "a", "a", "no  break \n x", "é" * 50_000, "Zeile " * 20_000]
    docs = spark.createDataFrame([(i % 6 if i else None, t, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids string")
    vocab = bpe.vocabulary(spark, PATH)
    out = bpe.decode_documents(bpe.encode_documents(docs, vocab, public_tokenizers.PATTERN), vocab)
    got = sorted(((r.text or "", r.ids, r.decoded) for r in out.collect()))
    want = sorted((t or "", np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), t or "") for t in texts)
    assert [(a, bytes(b), c) for a, b, c in got] == want
    both = bpe.round_trip(docs, vocab, public_tokenizers.PATTERN)
    assert sorted((r.text or "", bytes(r.coded.ids), r.coded.decoded) for r in both.collect()) == want
    assert bpe.digests(both.limit(0)).count() == 0


def test_query(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        want.add((d.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode_bytes(ids))))
    assert {tuple(r) for r in entry.queries()["op10_bpe_transducer"](spark, data).collect()} == want


def test_settle_forgets_what_a_worker_keeps():
    common.kept["Transducer-x"] = object()
    common.settle(forget=False)
    assert "Transducer-x" in common.kept
    common.settle()
    assert not common.kept
