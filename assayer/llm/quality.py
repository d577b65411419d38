"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts, one pass, in the tasks.  The trees are
fitted in numpy on the driver from a sample of labelled documents whose size is
bounded by ``max_rows`` (drawn by a hash of the id), and flattened
into arrays of equal depth.  Scoring walks a batch of rows down all levels of a
tree at once.

Rows: one score per input row, repeated rows included.  A null text counts as
empty and gets the score of an empty text.  Ids on several rows of the labels
count once with their mean label, ids on several documents once; null labels and ids teach nothing.
Without labels of both kinds every score is the share of label 1 (0.5 if there
is none at all).  A null doc_id counts as the empty text in the folds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import fresh, remainder5, settle

#: Bound of the labelled documents that a fit uses.
MAX_ROWS = 40_000
THRESHOLD = 0.3
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTER = np.array([65 <= b < 91 or 97 <= b < 123 or b > 127 for b in range(256)])
_END = re.compile(rb"[.!?](?:\s|$)")
NAMES = ("chars", "words", "lines", "word_length", "word_spread", "longest_word", "upper", "digits", "blanks",
         "marks", "beyond_ascii", "kinds_of_marks", "entropy", "distinct_words", "distinct_pairs",
         "most_frequent", "top_ten", "same_neighbours", "capitals", "all_upper", "marked_words", "unlettered",
         "short_words", "line_length", "line_spread", "distinct_lines", "repeated_line_bytes", "short_lines",
         "ends", "sentence_length", "distinct_tail", "distinct_head", "controls",
         *(f"mark_{m}" for m in range(len(MARKS))))


def statistics(text: str | None) -> list[float]:
    """The statistics ``NAMES`` of a whole text."""
    data = (text or "").encode()
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    share = counts[counts > 0] / n
    marks = counts[list(MARKS)]
    words = data.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    top = [c for _, c in seen.most_common(10)] or [0]
    lines = [x for x in data.split(b"\n") if x.strip()]
    many = Counter(lines)
    widths = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1)
    ends = len(_END.findall(data))
    upper = int(counts[65:91].sum())
    letters = max(1, int(counts[_LETTER].sum()))
    half = len(words) // 2
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), sizes.mean(), sizes.std(), sizes.max(),
        upper / letters, counts[48:58].sum() / n, (counts[32] + counts[9:14].sum()) / n, marks.sum() / n,
        counts[128:].sum() / n, np.count_nonzero(marks), -(share * np.log2(share)).sum(), len(seen) / w,
        len(set(zip(words, words[1:]))) / max(1, w - 1), top[0] / w, sum(top) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, sum(65 <= x[0] < 91 for x in words) / w,
        sum(map(bytes.isupper, words)) / w, sum(not (48 <= x[-1] < 58 or _LETTER[x[-1]]) for x in words) / w,
        sum(x.lower() == x.upper() and x[0] < 128 for x in words) / w, np.count_nonzero(sizes <= 3) / w,
        np.log1p(widths.mean()), np.log1p(widths.std()), len(many) / max(1, len(lines)),
        sum(len(x) * c for x, c in many.items() if c > 1) / n, np.count_nonzero(widths < 20) / max(1, len(lines)),
        ends / w, w / max(1, ends), len(set(words[half:])) / max(1, w - half), len(set(words[:half])) / max(1, half),
        (counts[:9].sum() + counts[14:32].sum()) / n, *(marks / n)]


@dataclass
class Trees:
    """Complete binary trees of one depth; what isn't split sends every row left."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray    # a row goes right if its value is above
    value: np.ndarray    # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while len(feature) and node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
        l2: float = 1.0, least: int = 10) -> Trees:
    """Boosted trees for the logistic loss, grown level by level from histograms."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if len(y) < 2 * least or y.min() == y.max():
        return Trees(base, *(np.zeros((0, k)) for k in (inner, inner, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    total, forest = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            best = np.full(nodes, 1e-6)
            at, where = np.full(nodes, -1), np.zeros(nodes, dtype=np.int64)
            for j, code in enumerate(codes):
                key = node * bins + code
                sums = [np.bincount(key, weights=v, minlength=nodes * bins).reshape(nodes, bins)
                        for v in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = ((np.cumsum(s, axis=1) for s in sums), (s.sum(axis=1)[:, None] for s in sums))
                gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = 0
                gain[:, len(edges[j]):] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(nodes), k]
                better = top > best
                best[better], at[better], where[better] = top[better], j, k[better]
            for q in np.flatnonzero(at >= 0):
                feature[first + q], limit[first + q] = at[q], edges[at[q]][where[q]]
            right = np.zeros(len(y), dtype=bool)
            split = at[node] >= 0
            right[split] = codes[at[node[split]], np.flatnonzero(split)] > where[node[split]]
            node = 2 * node + right
        value = -rate * np.bincount(node, weights=g, minlength=leaves) / (np.bincount(node, weights=h, minlength=leaves) + l2)
        total += value[node]
        forest.append((feature, limit, value))
    return Trees(base, *(np.array(a) for a in zip(*forest)))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", target: str = "quality",
          max_rows: int = MAX_ROWS) -> Trees:
    """Trees from the labelled documents outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & (remainder5(F.col("doc_id")) != 0)).groupBy("doc_id").agg(
        F.avg(F.col(target).cast("double")).alias("y")).where("y IS NOT NULL")
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007)) < int(1_000_000_007 * (max_rows / n)))

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        settle()
        for batch in batches:
            yield pd.Series([statistics(t) for t in batch], dtype=object)

    # at most about max_rows ids and labels: small enough to send to every task
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    found = rows.select("doc_id", "y", measure("text").alias("x")).groupBy("doc_id").agg(
        F.min("x").alias("x"), F.min("y").alias("y")).toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, len(NAMES))
    return fit(x, (found["y"].to_numpy(dtype=np.float64) >= 0.5).astype(np.float64))


def with_score(docs: DataFrame, trees: Trees, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        settle()
        for batch in batches:
            x = np.array([statistics(t) for t in batch]).reshape(-1, len(NAMES))
            yield pd.Series(shared.value.score(x))
            del batch, x
            settle()

    return docs.withColumn(into, score(F.col(text)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = with_score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", (remainder5(F.col("doc_id")) == 0).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score at least ``THRESHOLD``, with the columns of ``docs``."""
    into = fresh("score", docs.columns)
    return with_score(docs, train(docs, labels), into=into).where(F.col(into) >= THRESHOLD).drop(into)
