"""Best fit against a plain list of bins; packed rows give every document back."""

import random

import numpy as np
import public_tokenizers
import tiktoken

import __spark_entry__ as entry
from assayer.llm import bpe, packing
from assayer.llm.queries import PACK_RANKS

PATH = public_tokenizers.path(PACK_RANKS)


def test_best_fit_decreasing():
    rnd = random.Random(1)
    for most in (1, 2, 7, 64, 100):
        for _ in range(60):
            lengths = sorted((rnd.randint(1, most) for _ in range(rnd.randint(0, 80))), reverse=True)
            rooms: list[int] = []
            for n in lengths:
                fits = [r for r in rooms if r >= n]
                if fits:
                    rooms.remove(min(fits))
                    rooms.append(min(fits) - n)
                else:
                    rooms.append(most - n)
            got = packing.best_fit(lengths, most)
            assert sorted(i for b in got for i in b) == list(range(len(lengths)))
            assert sorted(most - sum(lengths[i] for i in b) for b in got) == sorted(rooms)


def back(rows, length):
    """Documents from packed rows: (doc_id, ids) of each."""
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert r.position_resets == r.cu_seqlens[:-1] and (ids[r.n_tokens:] == packing.END).all()
        at = packing.positions(r.cu_seqlens, length)
        assert len(at) == length and all(at[s] == 0 for s in r.position_resets)
        for d, o, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.setdefault(d, []).append((o, ids[a:b].tolist()))
    return pieces


def library():
    return tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_rows(spark):
    texts = [None, "", "a b c", "word " * 500, "x y " * 40_000, "same", "same"]
    docs = spark.createDataFrame([(i if i < 6 else 5, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    docs = docs.union(spark.createDataFrame([(None, "no id", "z")], docs.schema))
    vocab = bpe.vocabulary(spark, PATH)
    enc = library()
    for chars in (1000, 10 ** 7):
        packed = packing.pack(docs, vocab, length=64, group_chars=chars)
        rows = packed.collect()
        assert len({r.sequence for r in rows}) == len(rows)
        got = back(rows, 64)
        for d, t in zip([0, 1, 2, 3, 4, None], [*texts[:5], "no id"]):
            pieces = sorted(got[d])
            assert [o for o, _ in pieces] == [64 * k for k in range(len(pieces))]
            assert [i for _, p in pieces for i in p] == [*enc.encode_ordinary(t or ""), packing.END]
        assert [p for _, p in got[5]] == [[*enc.encode_ordinary("same"), packing.END]] * 2
    assert packing.pack(docs.limit(0), vocab).count() == 0


def test_write(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(30)], "doc_id long, text string")
    packing.write_packed(packing.pack(docs, bpe.vocabulary(spark, PATH), length=32), str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    assert packing.matrix(rows).shape == (len(rows), 32)


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    enc, got = library(), back(entry.queries()["op3_best_fit_packing"](spark, data).collect(), packing.LENGTH)
    assert {d: [i for _, p in sorted(v) for i in p] for d, v in got.items()} == {
        d.doc_id: [*enc.encode_ordinary(d.text or ""), packing.END] for d in docs}


def test_large_ids_beside_null(spark):
    docs = spark.createDataFrame([((1 << 60) + 1, "a"), ((1 << 60) + 3, "b c"), (None, "d")], "doc_id long, text string")
    out = packing.pack(docs.coalesce(1), bpe.vocabulary(spark, PATH), length=64)
    assert out.schema["doc_ids"].dataType.simpleString() == "array<bigint>"
    assert {d for r in out.collect() for d in r.doc_ids} == {(1 << 60) + 1, (1 << 60) + 3, None}
