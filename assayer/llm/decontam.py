"""Benchmark decontamination by Wu-Manber search over words.

The test strings are the windows of a benchmark: runs of ``window`` words of an
item, or the whole of a shorter one.  Words are the alphabet and a block is two
words.  A text is read from window end to window end: the shift table says how
far the next end may lie behind this block; where it says zero, the bucket of
the block's hash holds the test strings that end this way, and each is compared
word by word.  Texts are cut into lanes of equal length that numpy moves along together.

Rows: one result per input row, repeated rows included.  A null or empty text
has no words and no hits.  Benchmark rows without words take no part; those
without an id mark words as hit but name no item; an id on several rows is one
item.  Other columns pass through untouched.

The benchmark is a stated query set.  It is read in shards of about
``shard_chars`` characters, and only one shard is broadcast at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import LOWER, fresh, slices
from assayer.session import written

WINDOW = 13
LANE = 512
#: Letters, digits and all bytes beyond ASCII make words; everything else parts them.
WORDS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in LOWER)
RESULT = "n_words long, n_hit long, spans array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORDS).split() if text else []


class Strings:
    """The test strings of one length, with their shift table and buckets."""

    def __init__(self, patterns: list[tuple[int, ...]]):
        self.patterns = np.array(patterns, dtype=np.int32)
        self.length = self.patterns.shape[1]
        self.block = min(2, self.length)
        longest = self.length - self.block + 1
        size = 1 << max(12, (4 * self.patterns.size).bit_length())
        self.mask = size - 1
        self.shift = np.full(size, longest, dtype=np.int32)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self.hash(self.patterns, end), self.length - 1 - end)
        bucket = self.hash(self.patterns, self.length - 1)
        self.order = np.argsort(bucket, kind="stable")
        keys, first, count = np.unique(bucket[self.order], return_index=True, return_counts=True)
        self.first, self.count = np.zeros((2, size), dtype=np.int32)
        self.first[keys], self.count[keys] = first, count

    def hash(self, words: np.ndarray, end) -> np.ndarray:
        """Hash of the block that ends at ``end``, along the last axis."""
        h = words[..., end].astype(np.int64) * 0x9E3779B1
        if self.block == 2:
            h += words[..., end - 1].astype(np.int64) * 0x85EBCA77
        return ((h >> 15) ^ h) & self.mask

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, numbers of the test strings that end there)."""
        ends = np.arange(self.length - 1, len(words), LANE)
        stops = np.minimum(ends + LANE, len(words))
        found = []
        while len(ends):
            h = self.hash(words, ends)
            step = self.shift[h]
            zero = step == 0
            if zero.any():
                found.append(np.stack([ends[zero], h[zero]]))
            ends = ends + np.maximum(step, 1)
            on = ends < stops
            if not on.all():
                ends, stops = ends[on], stops[on]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, h = np.concatenate(found, axis=1)
        hits = [self._compare(words, at[i:i + 50_000], h[i:i + 50_000]) for i in range(0, len(at), 50_000)]
        return tuple(np.concatenate(x) for x in zip(*hits))

    def _compare(self, words, at, h):
        ends, numbers = [], []
        rank, count = 0, self.count[h]
        while len(at):
            on = count > rank
            at, h, count = at[on], h[on], count[on]
            number = self.order[self.first[h] + rank]
            same, where, rank = np.arange(len(at)), at, rank + 1
            for k in range(self.length):  # direct comparison, first words first
                same = same[words[where[same] - self.length + 1 + k] == self.patterns[number[same], k]]
            ends.append(at[same])
            numbers.append(number[same])
        return (np.concatenate(ends) if ends else np.empty(0, np.int64),
                np.concatenate(numbers) if numbers else np.empty(0, np.int64))


class Matcher:
    """All test strings of a shard of the benchmark."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners.setdefault(size, {}).setdefault(tuple(ids[i:i + size]), set()).add(item)
        self.tables = [(Strings(list(by)), [sorted(x for x in o if x is not None) for o in by.values()])
                       for _, by in sorted(owners.items())]

    def scan(self, texts: list[str | None], before: list[tuple[list[int], list[str]]]) -> pd.DataFrame:
        get, parts, sizes = self.vocabulary.get, [], []
        for text in texts:  # 0: a word of no test string, 1: the end of a text
            words = words_of(text)
            sizes.append(len(words))
            parts.append(np.array([*map(get, words, repeat(0)), 1], dtype=np.int32))
        sizes = np.array(sizes, dtype=np.int64)
        words = np.concatenate(parts)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        edges = np.zeros(len(words) + 1, dtype=np.int32)
        items = [set(old) for _, old in before]
        for d, (spans, _) in enumerate(before):
            np.add.at(edges, starts[d] + np.array(spans[::2], dtype=np.int64), 1)
            np.add.at(edges, starts[d] + np.array(spans[1::2], dtype=np.int64), -1)
        for strings, owners in self.tables:
            ends, numbers = strings.search(words)
            np.add.at(edges, ends + 1 - strings.length, 1)
            np.add.at(edges, ends + 1, -1)
            docs = np.searchsorted(starts, ends, side="right") - 1
            for d, n in np.unique(np.stack([docs, numbers]), axis=1).T.tolist():
                items[d].update(owners[n])
        hit = np.cumsum(edges[:-1]) > 0
        turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        of = np.searchsorted(starts, turns, side="right") - 1
        cuts = np.searchsorted(of[::2], np.arange(len(texts) + 1)) * 2
        spans = [(turns[a:b] - starts[d]).tolist() for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
        return pd.DataFrame({"n_words": sizes, "n_hit": [sum(s[1::2]) - sum(s[::2]) for s in spans],
                             "spans": spans, "items": [sorted(i) for i in items]})


def shards(benchmark: DataFrame, item: str, text: str, shard_chars: int, window: int) -> Iterator[Matcher]:
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where(
        F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / shard_chars))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Matcher([tuple(r) for r in part.collect()], window)


def with_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id",
              item_text: str = "text", into: str = "hits", window: int = WINDOW,
              shard_chars: int = 8_000_000) -> DataFrame:
    """``docs`` with a struct: words, words inside a test string, the spans of those
    (word numbers: start, behind, start, ...) and the items whose windows occur."""
    spark = docs.sparkSession
    for k, matcher in enumerate(shards(benchmark, item, item_text, shard_chars, window)):
        shared = spark.sparkContext.broadcast(matcher)

        @F.pandas_udf(RESULT)
        def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, spans, items in batches:
                texts = texts.tolist()
                done = [([], []) if s is None else (list(s), list(i)) for s, i in zip(spans, items)]
                out = [shared.value.scan(texts[a:b], done[a:b]) for a, b in slices(texts)]
                yield pd.concat(out) if out else pd.DataFrame(
                    {c: [] for c in ("n_words", "n_hit", "spans", "items")})

        if not k:
            none = (F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>"))
            docs = docs.withColumn(into, scan(F.col(text), *none))
        else:
            docs = written(docs, "hits").withColumn(
                into, scan(F.col(text), F.col(f"`{into}`.spans"), F.col(f"`{into}`.items")))
    return docs


def contaminated(hits: str):
    """The rule: at least one word in twenty lies inside a test string."""
    n, words = F.col(f"`{hits}`.n_hit"), F.col(f"`{hits}`.n_words")
    return (n > 0) & (20 * n >= words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = with_hits(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated("hits").alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    into = fresh("hits", docs.columns)
    return with_hits(docs, benchmark, into=into).where(~contaminated(into)).drop(into)
