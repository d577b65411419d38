"""Periodic runs of words: recursive frequency splitting, then a scan of lags.

A run is a stretch of words with smallest period q and a length of at least ``repeats``
periods and ``least`` words that no neighbouring word extends.  Each of its words
occurs ``repeats`` times in it at least, so a word that is rarer within a segment
splits the segment, and parts shorter than ``least`` go.  Parts are counted anew until nothing
changes.  The texts of a batch are split together, in arrays.

What is left is scanned lag by lag.  A run of period q holds ``repeats`` consecutive
multiples of q, so only every q-th word is compared first (m / q steps for m words);
where these agree, the words between follow, and the stretch is extended to both sides.
Stretches inside a run found before, of a period that divides q, are not tried again.

Rows: null and empty texts have no words and no runs.  Repeated rows have equal
results; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import slices

LEAST = 6
REPEATS = 4
#: Words compared behind a candidate before the rest of it.
PROBE = 8


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def segments(words: np.ndarray, docs: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """(start, behind) of the stretches whose words all occur ``repeats`` times in their own
    stretch; ``docs`` ascends and tells the texts apart."""
    at, part = np.arange(len(words)), docs
    while len(at):
        order = np.lexsort((words[at], part))
        w, p = words[at][order], part[order]
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (p[1:] != p[:-1])]))
        count = np.empty(len(at), dtype=np.int64)
        count[order] = np.repeat(np.diff(np.append(first, len(at))), np.diff(np.append(first, len(at))))
        on = count >= repeats
        left, of = at[on], part[on]
        if not len(left):
            return np.zeros((0, 2), dtype=np.int64)
        # what stood apart, or in different parts, stays apart
        turn = np.concatenate([[True], (np.diff(left) > 1) | (of[1:] != of[:-1])])
        new = np.cumsum(turn) - 1
        long = np.bincount(new) >= least
        keep = long[new]
        done = on.all() and keep.all()
        at, part = left[keep], new[keep]
        if done:
            break
    if not len(at):
        return np.zeros((0, 2), dtype=np.int64)
    turn = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return np.stack([at[turn], at[np.append(turn[1:], len(at)) - 1] + 1], axis=1)


def _reach(w: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The widest stretch around ``at`` with period q, as (start, behind)."""
    behind, size = at, max(64, 4 * q)
    while behind + q < len(w):
        same = w[behind:behind + size]
        same = same[:len(w) - q - behind] == w[behind + q:behind + q + size]
        if same.all():
            behind, size = behind + len(same), 2 * size
        else:
            behind += int(same.argmin())
            break
    start, size = at, max(64, 4 * q)
    while start > 0:
        low = max(0, start - size)
        same = (w[low:start] == w[low + q:start + q])[::-1]
        if same.all():
            start, size = low, 2 * size
        else:
            start -= int(same.argmin())
            break
    return start, behind + q


class _Runs:
    """Runs found so far, by period.  Of two of one period the later ends later, too."""

    def __init__(self):
        self.of: dict[int, list[tuple[int, int]]] = {}

    def add(self, start: int, behind: int, q: int) -> None:
        self.of.setdefault(q, []).append((start, behind))

    def hold(self, at: np.ndarray, behind: np.ndarray, q: int) -> np.ndarray:
        """Whether each stretch lies in a run whose period divides q."""
        inside = np.zeros(len(at), dtype=bool)
        for p, runs in self.of.items():
            if q % p == 0:
                start, end = np.array(runs).T
                k = np.searchsorted(start, at, side="right") - 1
                inside |= (k >= 0) & (behind <= end[k])
        return inside


def scan(w: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one stretch, by start and period."""
    found, known = [], _Runs()
    for q in range(1, len(w) // repeats + 1):
        line = w[::q]
        same = line[1:] == line[:-1]
        hits = same[repeats - 2:].copy()
        for i in range(repeats - 2):
            hits &= same[i:i + len(hits)]
        k = np.flatnonzero(hits) * q
        if not len(k):
            continue
        k = k[~known.hold(k, k + (repeats - 1) * q + 1, q)]
        for i in range(1, min(q, PROBE)):
            k = k[w[k + i] == w[k + q + i]]
        behind = -1
        for a in k.tolist():
            if a < behind:  # of a stretch that was tried with this lag
                continue
            start, end = _reach(w, a, q)
            behind = end - q
            if end - start >= max(least, repeats * q) and not known.hold(np.array([start]), np.array([end]), q)[0]:
                found.append((start, end - start, q))
                known.add(start, end, q)
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeats_of(texts: list[str | None], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, list, str]]:
    """(words, runs, text without repeats) of each text."""
    split = [words_of(t) for t in texts]
    size = np.array([len(s) for s in split], dtype=np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter(map(number.setdefault, chain.from_iterable(split), count()), np.int64, int(size.sum()))
    docs = np.repeat(np.arange(len(split)), size)
    begin = np.concatenate([[0], np.cumsum(size)])
    runs: list[list] = [[] for _ in split]
    for a, b in segments(ids, docs, least, repeats).tolist():
        d = int(docs[a])
        runs[d] += [(a + s - int(begin[d]), n, q) for s, n, q in scan(ids[a:b], least, repeats)]
    out = []
    for own, found in zip(split, runs):
        found.sort(key=lambda r: (r[0], r[2]))
        if found:
            gone = np.zeros(len(own) + 1, dtype=np.int64)
            for s, n, q in found:
                gone[s + q] += 1
                gone[s + n] -= 1
            kept = [w for w, g in zip(own, np.cumsum(gone).tolist()) if not g]
        else:
            kept = own
        out.append((len(own), found, b" ".join(kept).decode()))
    return out


def with_runs(docs: DataFrame, *, text: str | Column = "text", into: str = "repeats", least: int = LEAST,
              repeats: int = REPEATS) -> DataFrame:
    """``docs`` with a struct: n_words, runs (start, length, period by start, then period) and
    collapsed, the words that no run holds after its first period, joined by spaces."""
    if repeats < 2 or least < 2:
        raise ValueError("a run repeats twice at least")

    @F.pandas_udf("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            rows = [r for a, b in slices(texts) for r in repeats_of(texts[a:b], least, repeats)]
            yield pd.DataFrame({"n_words": pd.Series([r[0] for r in rows], dtype="int64"), "runs": pd.Series(
                [[{"start": s, "length": n, "period": q} for s, n, q in r[1]] for r in rows], dtype=object),
                "collapsed": pd.Series([r[2] for r in rows], dtype=object)})

    return docs.withColumn(into, find(F.col(text) if isinstance(text, str) else text))


def planted(text: Column, doc_id: Column) -> Column:
    """The words of the text joined by spaces; of one text in ten, by the crc32 of its id, all
    words from some place on repeat.  A null id counts as the empty text."""
    @F.pandas_udf("string")
    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hashes in batches:
            out = []
            for t, h in zip(texts, hashes):
                own = words_of(t)
                if own and h % 10 == 0:
                    g, n = h // 10, len(own)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    tail = own[a:a + p]
                    own = own[:a] + (tail * (1 + (n - a) // p))[:n - a]
                out.append(b" ".join(own).decode())
            yield pd.Series(out, dtype=object)

    return rewrite(text, F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")))


def report(docs: DataFrame) -> DataFrame:
    rows = with_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.expr("""array_min(transform(repeats.runs,
        r -> struct(-r.length AS rank, r.start AS start, r.period AS period, r.length AS length)))""")
    lines = F.expr("array_join(transform(repeats.runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return rows.select("doc_id", F.size("repeats.runs").cast("long").alias("n_runs"), longest.alias("top"),
                       F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("repeats.collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period",
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
