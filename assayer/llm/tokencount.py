"""Token counts under a unigram model by dynamic programming over a trie.

Text is cut into pre-tokens, and each distinct one is inserted into a trie of
bytes.  A node holds the best score of its prefix and the number of tokens of
the segmentation that has it: the forward step from its ancestors, taken once
per node, so that pre-tokens share the work on what they have in common.  Where
a pre-token ends the node is terminal, and its count is all that documents need.

Every task grows its own trie; a trie that has grown to ``NODES`` nodes is begun anew,
which changes no result.  Nothing is shuffled.

Scores are whole millionths of nats, so equal scores are equal; of equal scores
the segmentation with fewer tokens counts.  The public vocabulary files
hold ranks and no probabilities: a token of rank r weighs ln(r + 2), as in Zipf's law.

Rows: one result per input row, repeated rows included.  A null or empty text
has no tokens.  A pre-token of more than ``LONG`` bytes takes the same steps in
an array of its own.  Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.bpe import _once
from assayer.llm.common import in_slices

NODES = 400_000
WORDS = 150_000
LONG = 256
UNIT = 1_000_000
_SHIFT = 40


def weight(rank: int) -> int:
    return round(UNIT * math.log(rank + 2))


class Trie:
    """Forward scores of prefixes.  A value packs score and count: score << 40 | count, so
    that the smaller value is the better segmentation and values add up."""

    def __init__(self, ranks: dict[bytes, int]):
        #: Tokens spelt backwards: (node, byte) -> node; value of the token that begins there.
        self.back: dict[int, int] = {}
        self.value: list[int] = [0]
        for token, rank in ranks.items():
            node = 0
            for b in reversed(token):
                key = node << 8 | b
                if key not in self.back:
                    self.back[key] = len(self.value)
                    self.value.append(0)
                node = self.back[key]
            self.value[node] = weight(rank) << _SHIFT | 1
        self.clear()

    def clear(self) -> None:
        self.kids: dict[int, int] = {}
        self.best: list[int] = [0]

    def _forward(self, word: bytes, end: int, best: list[int]) -> int:
        """Best value of ``word[:end]`` from those of its shorter prefixes."""
        node, at, found = 0, end, -1
        back, value = self.back, self.value
        while at:
            at -= 1
            node = back.get(node << 8 | word[at], -1)
            if node < 0:
                break
            if value[node] and best[at] >= 0:
                now = best[at] + value[node]
                if found < 0 or now < found:
                    found = now
        return found

    def insert(self, word: bytes) -> int:
        """Value of the node at which ``word`` ends."""
        if len(word) > LONG:
            best = [0]
            for end in range(1, len(word) + 1):
                best.append(self._forward(word, end, best))
            return best[-1]
        if len(self.best) > NODES:
            self.clear()
        node, path, kids = 0, [0], self.kids
        for end, b in enumerate(word, 1):
            key = node << 8 | b
            child = kids.get(key)
            if child is None:
                child = kids[key] = len(self.best)
                self.best.append(self._forward(word, end, path))
            path.append(self.best[child])
            node = child
        return path[-1]


class Terminals(dict):
    """Value of each pre-token met; what is not used again is forgotten."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie, self.older = trie, {}

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        if value is None:
            value = self.trie.insert(word.encode())
            if value < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
        if len(word) <= 64:
            self[word] = value
        return value


def count_tokens(docs: DataFrame, vocab, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score): counts of whole texts, and the log-probability
    (in nats, up to the model's constant) of the segmentations counted."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terminals, find = Terminals(_once(Trie, vocab)), regex.compile(pattern).findall

        def work(part: pd.DataFrame) -> pd.DataFrame:
            cut = [find(t) if t else [] for t in part["text"]]
            total = [sum(map(terminals.__getitem__, words)) for words in cut]
            return pd.DataFrame({"doc_id": part["doc_id"], "n_pretokens": [len(w) for w in cut],
                                 "n_tokens": [t & (1 << _SHIFT) - 1 for t in total],
                                 "score": [-(t >> _SHIFT) / UNIT for t in total]})

        yield from in_slices(batches, "text", work)

    kind = docs.schema["doc_id"].dataType.simpleString()
    # ids travel as text: beside a null, pandas would make doubles of them
    out = docs.select(F.col("doc_id").cast("string"), F.col(text).alias("text")).mapInPandas(
        run, "doc_id string, n_pretokens long, n_tokens long, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
