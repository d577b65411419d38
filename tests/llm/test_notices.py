"""Notices with errors against edit distances of all stretches of words."""

import random
import re

from assayer.llm import notices
from assayer.llm.notices import BASE, NOTICES, Finder, Notice


def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fewest(notice, words):
    """Fewest edits of the notice over all stretches of words, or None."""
    all_, least = notice.phrase.split(" "), None
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            own = words[i:j]
            if abs(len(" ".join(own)) - len(notice.phrase)) > notice.edits:
                continue
            if notice.key is None:
                e = [distance(" ".join(own), notice.phrase)]
            else:
                k = all_.index(notice.key)
                e = [distance(" ".join(own[:p]), " ".join(all_[:k])) + distance(" ".join(own[p + 1:]), " ".join(all_[k + 1:]))
                     for p in range(len(own)) if own[p] == notice.key and bool(p) == bool(k)
                     and (p < len(own) - 1) == (k < len(all_) - 1)]
            e = [x for x in e if x <= notice.edits]
            if e:
                least = min(e + ([least] if least is not None else []))
    return least


def base_places(words):
    return [(i, n.label) for n in BASE for i in range(len(words))
            if words[i:i + len(n.phrase.split())] == n.phrase.split()]


def damaged(rnd, phrase, edits):
    s = list(phrase)
    for _ in range(edits):
        i, kind = rnd.randrange(len(s)), rnd.randrange(3)
        s[i:i + (kind > 0)] = [rnd.choice("abet 2")] if kind < 2 else []
    return "".join(s)


def test_against_all_stretches():
    rnd, finder, near = random.Random(7), Finder(NOTICES), 0
    for _ in range(150):
        notice = rnd.choice(NOTICES)
        text = " ".join([rnd.choice(["so", "the", "license", "x y", ""]), damaged(rnd, notice.phrase, rnd.randint(0, notice.edits + 2)),
                         rnd.choice(["2", "license", "under", ""])])
        words = plain_words(text)
        spans = finder.spans(words)
        for i, n in enumerate(NOTICES):
            got = [e for _, _, k, e in spans if k == i]
            assert (min(got) if got else None) == fewest(n, words), (text, n)
            near += bool(got) and min(got) > 0
        assert sorted(a for a, _, k, _ in spans if k < len(BASE)) == sorted(i for i, _ in base_places(words))
    assert near > 50


def test_spans():
    finder = Finder([Notice("x", "a b a"), Notice("y", "under the mit license", 2, "mit")])
    assert [s[:3] for s in finder.spans("a b a b a z".split())] == [(0, 3, 0), (2, 5, 0)]
    assert finder.spans("see undr the mit licence now".split()) == [(1, 5, 1, 2)]
    assert finder.spans("under the bit license".split()) == []
    assert finder.spans([]) == [] and Finder([]).spans(["a"]) == []


def test_rows(spark):
    docs = spark.createDataFrame([
        (1, "Under the MIT License. CC BY-NC! cc by nc", 5), (1 << 60 | 1, "undr the mit licens", 0), (None, None, None), (2, "", 1),
        (2, "", 1), (3, "mit " * 50_000 + "apache license, version 2", 1)], "doc_id long, text string, spans int")
    got = {(r.doc_id, r.n_words): r for r in notices.report(docs).collect()}
    assert tuple(got[1, 10])[2:] == (3, 0, 7, "cc-by-nc,mit", "cc-by-nc,mit", 1.0)
    fuzzy = got[1 << 60 | 1, 4]
    assert tuple(fuzzy)[2:7] == (0, None, None, "", "mit") and fuzzy.score == 1 - 2 / 21
    assert tuple(got[None, 0])[2:] == tuple(got[2, 0])[2:] == (0, None, None, "", "", 0.0)
    assert tuple(got[3, 50_004])[2:6] == (1, 50_000, 50_000, "apache-2")
    assert notices.report(docs).count() == 6 and notices.report(docs.limit(0)).count() == 0
    full = notices.with_notices(docs, into="hits")
    assert full.columns == [*docs.columns, "hits"]


def test_given_documents(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r for r in notices.report(df).collect()}
    for d in df.collect():
        words, r = plain_words(d.text), got[d.doc_id]
        places = base_places(words)
        at = [i for i, _ in places]
        assert tuple(r)[1:6] == (len(words), len(places), min(at, default=None), max(at, default=None),
                                 ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not places)
