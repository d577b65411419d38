"""Periodic runs against every stretch of every period."""

import hashlib
import random
import re
import zlib

from assayer.llm import periodic


def plain_words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def rewritten(words, doc_id):
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute(w, least=6, times=4):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)  # the smallest period of the stretch comes first
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def expected(doc_id, text):
    w = rewritten(plain_words(text), doc_id)
    runs = brute(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(collapsed(w, runs))))


def test_small_alphabets():
    rnd, seen = random.Random(3), 0
    for _ in range(1500):
        words = rnd.choices("abcd"[:rnd.randint(1, 4)], k=rnd.randint(0, 60))
        if rnd.random() < 0.6:
            part = rnd.choices("abcdefgh", k=rnd.randint(1, 9))
            words += part * rnd.randint(2, 7) + part[:rnd.randint(0, len(part))] + rnd.choices("abxyz", k=3)
        want = brute(words)
        n, runs, left = periodic.repeats_of([" ".join(words)])[0]
        assert (n, runs, left) == (len(words), want, " ".join(collapsed(words, want))), words
        seen += len(want)
    assert seen > 1000


def test_a_batch_is_split_text_by_text():
    texts = ["a a a", None, "a a a a a a", "", "b " * 7, "x y " * 5]
    assert [r[1] for r in periodic.repeats_of(texts)] == [[], [], [(0, 6, 1)], [], [(0, 7, 1)], [(0, 10, 2)]]


def test_segments_are_stable():
    """A rare word splits, which makes others rare in the parts."""
    words = "a b a b z a b c a b c y a b a b a b a b".split()
    _, runs, _ = periodic.repeats_of([" ".join(words)])[0]
    assert runs == [(12, 8, 2)]


def test_rows(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices("abcdefghij", k=rnd.randint(0, 80))), i) for i in range(60)]
    rows += [(1 << 60 | 1, "A a\tA a A a A a   x", 0), (None, "q " * 9, None), (None, None, 1), (4, "", 1), (4, "", 1),
             (77, "long tail " * 20_000 + "end", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repeats int")
    got = sorted(map(tuple, periodic.report(docs).collect()), key=str)
    small = sorted((expected(i, t) for i, t, _ in rows if i != 77), key=str)
    assert [r for r in got if r[0] != 77] == small
    assert [r[2:5] for r in got if r[0] == 77] == [(0, 40_000, 2)] or zlib.crc32(b"77") % 10 == 0
    assert periodic.report(docs.limit(0)).count() == 0


def test_given_documents(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    short = [r for r in df.select("doc_id", "text").collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in periodic.report(df).collect()}
    assert len(got) == df.count()
    assert all(got[r.doc_id] == expected(r.doc_id, r.text) for r in short)
    assert sum(got[r.doc_id][1] > 0 for r in short) > 10
