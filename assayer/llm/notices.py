"""Short licence notices with errors: exact seeds, then bounded-error matching.

A text is a line of its lower-cased words, joined by single spaces.  A notice is a phrase
with a number of allowed edits k (characters added, left out or changed) and, where a
neighbouring notice differs in one word, a key word that must stand as it is.  The phrase is
cut into k + 1 pieces: k edits leave one of them whole, so every occurrence shows a piece at no
more than k characters from its place.  All pieces of all notices are found in one pass
of an automaton; around each, the fewest edits are determined by the regex library's
fuzzy matching, from word to word.  A phrase without edits is one piece.

Spans of one notice that overlap a better one (fewer edits, then the earlier) go; exact
ones all stay.  The edits of a notice with a key word are counted on each side of the key.

Rows: null and empty texts have no words and no spans.  Repeated rows have equal results; other
columns, whatever their names, are kept and not looked at.  A task memorises a bounded number of
places; results don't depend on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import LOWER


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    edits: int = 0
    key: str | None = None


# Phrases of the contract with their labels.
BASE = (
    Notice("mit", "under the mit license"),
    Notice("apache-2", "apache license version 2"),
    Notice("cc-by-nc", "cc by nc"),
)
#: Notices of well-known licences, about one edit for ten characters.
MORE = (
    Notice("mit", "under the mit license", 2, "mit"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("apache-2", "apache license version 2", 2, "2"),
    Notice("apache-2", "apache software license version 2", 3, "2"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 9),
    Notice("bsd", "under the bsd license", 2, "bsd"),
    Notice("gpl", "gnu general public license", 2),
    Notice("lgpl", "gnu lesser general public license", 3, "lesser"),
    Notice("agpl", "gnu affero general public license", 3, "affero"),
    Notice("mpl-2", "mozilla public license version 2", 3, "2"),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("cc0", "creative commons zero", 2, "zero"),
    Notice("unlicense", "free and unencumbered software released into the public domain", 6),
    Notice("reserved", "all rights reserved", 1, "rights"),
)
NOTICES = BASE + MORE

_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: LOWER[i] for i in range(65, 91)}
MEMO = 100_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    n, parts = len(notice.phrase), notice.edits + 1
    if parts > n:
        raise ValueError(f"as many edits as {notice.phrase!r} has characters")
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, notice.phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern(notice: Notice) -> regex.Pattern:
    """Matches from the space before the notice to the one behind it, with as few edits as can be."""
    def loose(part: str) -> str:
        return f"(?:{regex.escape(part)}){{e<={notice.edits}}}" if notice.edits and part else regex.escape(part)

    if notice.key is None:
        return regex.compile(f"(?b) {loose(notice.phrase)} ")
    left, found, right = f" {notice.phrase} ".partition(f" {notice.key} ")
    if not found:
        raise ValueError(f"{notice.key!r} is no word of {notice.phrase!r}")
    before, behind = left.removeprefix(" "), right.removesuffix(" ")
    return regex.compile("(?b)" + (f" {loose(before)}" if before else "") + regex.escape(found)
                         + (f"{loose(behind)} " if behind else ""))


class Finder:
    """All notices compiled: the automaton of pieces and a pattern each."""

    def __init__(self, notices: Sequence[Notice]):
        self.notices = tuple(notices)
        self.patterns = [pattern(n) for n in self.notices]
        held: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for at, piece in pieces(notice):
                held.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, of in held.items():
            self.seeds.add_word(piece, (len(piece), of))
        if held:
            self.seeds.make_automaton()
        self.best = lru_cache(MEMO)(self._best)

    def _best(self, number: int, part: str) -> tuple[int, int, int] | None:
        """(start, behind, edits) of the best match in a stretch of a line, without its outer spaces."""
        m = self.patterns[number].search(part)
        if m is None or sum(m.fuzzy_counts) > self.notices[number].edits:
            return None
        return m.start() + 1, m.end() - 1, sum(m.fuzzy_counts)

    def spans(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(start, behind, notice, edits) by start, then end and notice; words count from 0."""
        if not words or not self.notices:
            return []
        line = f" {' '.join(words)} "
        tried, found = set(), set()
        for last, (size, of) in self.seeds.iter(line):
            for i, at in of:
                notice = self.notices[i]
                from_ = last - size + 1 - at
                a, b = max(0, from_ - notice.edits - 1), min(len(line), from_ + len(notice.phrase) + notice.edits + 1)
                if (i, a, b) in tried:
                    continue
                tried.add((i, a, b))
                hit = self.best(i, line[a:b])
                if hit:
                    found.add((i, a + hit[0], a + hit[1], hit[2]))
        if not found:
            return []
        kept: list[tuple[int, int, int, int]] = []
        by: dict[int, list] = {}
        for x in found:
            by.setdefault(x[0], []).append(x)
        for own in by.values():
            kept += _apart(own)
        number, places, at, n = {}, sorted({p for x in kept for p in (x[1], x[2])}), 0, -1
        for p in places:
            n += line.count(" ", at, p)
            number[p], at = n, p
        return sorted((number[a], number[b] + 1, i, e) for i, a, b, e in kept)


def _apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of one notice without the inexact ones that overlap a better one."""
    out, group, end = [], [], -1
    for x in sorted(found, key=lambda x: (x[1], x[2])) + [(0, 1 << 62, 1 << 62, 0)]:
        if x[1] >= end and group:  # only spans of one chain of overlaps meet
            kept: list = []
            for y in sorted(group, key=lambda y: (y[3], y[1], y[2])):
                if not y[3] or all(y[2] <= z[1] or z[2] <= y[1] for z in kept):
                    kept.append(y)
            out += kept
            group = []
        group.append(x)
        end = max(end, x[2])
    return out


def with_notices(docs: DataFrame, notices: Sequence[Notice] = NOTICES, *, text: str | Column = "text",
                 into: str = "notices") -> DataFrame:
    """``docs`` with a struct: n_words and spans, an array by start of (start, behind: words from 0;
    label, phrase, edits, similarity: 1 - edits / characters of the phrase)."""
    notices = tuple(notices)

    @F.pandas_udf("n_words long, spans array<struct<start: long, behind: long, notice: int, edits: int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder(notices)
        for batch in batches:
            n, spans = [], []
            for t in batch:
                words = words_of(t)
                n.append(len(words))
                spans.append([dict(zip(("start", "behind", "notice", "edits"), s)) for s in finder.spans(words)])
            yield pd.DataFrame({"n_words": pd.Series(n, dtype="int64"), "spans": pd.Series(spans, dtype=object)})

    facts = F.array(*[F.struct(F.lit(x.label).alias("label"), F.lit(x.phrase).alias("phrase"),
                               F.lit(float(len(x.phrase))).alias("size")) for x in notices])
    if not notices:
        facts = F.lit(None).cast("array<struct<label: string, phrase: string, size: double>>")

    def named(s: Column) -> Column:
        own = F.get(facts, s["notice"])
        return F.struct(s["start"].alias("start"), s["behind"].alias("behind"), s["notice"].alias("notice"),
                        own["label"].alias("label"), own["phrase"].alias("phrase"), s["edits"].alias("edits"),
                        (1 - s["edits"] / own["size"]).alias("similarity"))

    raw = docs.withColumn(into, find(F.col(text) if isinstance(text, str) else text))
    return raw.withColumn(into, F.struct(F.col(f"`{into}`.n_words").alias("n_words"),
                                         F.transform(F.col(f"`{into}`.spans"), named).alias("spans")))


def report(docs: DataFrame) -> DataFrame:
    """Base phrases by place, labels of all notices and the highest similarity of each document."""
    rows = with_notices(docs.select("doc_id", "text")).select("doc_id", "notices.n_words", "notices.spans")
    base = F.filter("spans", lambda s: s["notice"] < len(BASE))
    first = F.transform(base, lambda s: s["start"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"))
