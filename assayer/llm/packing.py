"""Packed token ids: best-fit-decreasing with a segment tree over free capacity.

Texts become ids with an end mark.  A document longer than a sequence is split
into pieces that together are the document.  Rows are dealt at random into groups of about
``GROUP_CHARS`` characters, whatever the size of the corpus; in a group pieces
go, longest first, each into the open sequence with the least room that
still holds it.  The segment tree over capacities finds that room in a few
steps.  What leaves is a matrix row of ids, the cumulative lengths of the
segments, and where positions begin again.

Rows: each input row is packed once, repeated rows included.  A null or empty
text is its end mark alone.  Within a group the order is length (longest
first), doc_id (null first), row.  No rows give no sequences.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from assayer.llm.bpe import _once

LENGTH = 2048
GROUP_CHARS = 4_000_000
END = 50_256
RESULT = ("sequence string, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
          "doc_ids array<{0}>, offsets array<int>")


class CapacityTree:
    """How many open sequences have each free capacity; finds the least one that fits."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most.bit_length())
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, change: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += change
            node >>= 1

    def fit(self, length: int) -> int:
        """The least capacity in use that is at least ``length``; -1 if there is none."""
        node = length + self.size
        if self.count[node]:
            return length
        while node > 1:  # up until a subtree to the right holds one, then down on its left
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Numbers of the pieces in each sequence; ``lengths`` fall and are at most ``most``."""
    tree, free, out = CapacityTree(most), {}, []
    for i, n in enumerate(lengths):
        room = tree.fit(n)
        if room < 0:
            room, k = most, len(out)
            out.append([])
        else:
            k = free[room].pop()
            tree.add(room, -1)
        out[k].append(i)
        if room > n:
            free.setdefault(room - n, []).append(k)
            tree.add(room - n, 1)
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import public_tokenizers
        self.library = tiktoken.Encoding("packed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                         special_tokens={})
        self.end = max(ranks.values()) + 1
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def ids(self, text: str | None) -> bytes:
        ids = self.library.encode_ordinary(text) if text else []
        ids.append(self.end)
        return np.array(ids, dtype=self.kind).tobytes()


def encode(docs: DataFrame, vocab, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of a public vocabulary and an end mark, little-endian, two bytes
    each where the vocabulary allows it and four where not."""
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _once(Encoder, vocab)
        for batch in batches:
            yield pd.Series([encoder.ids(t) for t in batch], dtype=object)

    return docs.withColumn(into, run(F.col(text)))


def pack(docs: DataFrame, vocab, *, length: int = LENGTH, group_chars: int = GROUP_CHARS, text: str = "text") -> DataFrame:
    """Packed sequences of ``docs``:

    sequence         name, unique in the result
    n_tokens         ids before the filling
    ids              one row of the id matrix, filled up with the end mark
    cu_seqlens       0 and the end of each segment
    position_resets  where positions begin again from zero
    doc_ids, offsets document of each segment and the token of it at which it begins
    """
    total = docs.agg(F.sum(F.length(text)), F.count(F.lit(1))).first()
    groups = max(1, math.ceil(((total[0] or 0) + total[1]) / group_chars))
    end = max(vocab.value[1].values()) + 1
    kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
    name = docs.schema["doc_id"].dataType.simpleString()
    number = int if isinstance(docs.schema["doc_id"].dataType, IntegralType) else str

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid")
        data = [np.frombuffer(b, dtype=kind) for b in rows["ids"]]
        of = [None if pd.isna(i) else number(i) for i in rows["doc_id"]]
        pieces = [(d, at, min(length, len(x) - at)) for d, x in enumerate(data) for at in range(0, len(x), length)]
        pieces.sort(key=lambda p: (-p[2], of[p[0]] is not None, of[p[0]] if of[p[0]] is not None else 0, p[0], p[1]))
        out = []
        for n, own in enumerate(best_fit([p[2] for p in pieces], length)):
            own = [pieces[i] for i in own]
            ends = np.cumsum([0] + [p[2] for p in own])
            line = np.full(length, end, dtype=kind)
            for (d, at, size), to in zip(own, ends):
                line[to:to + size] = data[d][at:at + size]
            out.append((f"{key[0]}-{n}", int(ends[-1]), line.tobytes(), ends.tolist(), ends[:-1].tolist(),
                        [None if of[p[0]] is None else str(of[p[0]]) for p in own], [p[1] for p in own]))
        return pd.DataFrame(out, columns=["sequence", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids",
                                          "offsets"], dtype=object)

    coded = encode(docs.select("doc_id", F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid")), vocab)
    # ids travel as text: beside a null, pandas would make doubles of them
    packed = coded.select(F.col("doc_id").cast("string"), "rid", "ids", F.pmod(F.xxhash64("rid"), F.lit(groups)).alias("g"))
    return packed.groupBy("g").applyInPandas(run, RESULT.format("string")).withColumn(
        "doc_ids", F.col("doc_ids").cast(f"array<{name}>"))


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrix as Parquet: a row of it is a row of the table, ids in the column ``ids``."""
    packed.write.parquet(path)


def matrix(rows: list, kind: str = "<u2") -> np.ndarray:
    """The id matrix of some collected rows."""
    return np.stack([np.frombuffer(r.ids, dtype=kind) for r in rows])


def positions(cu_seqlens: list[int], length: int = LENGTH) -> np.ndarray:
    """Position ids of a row: each segment counts from zero, the filling as one more."""
    ends = [*cu_seqlens, length]
    return np.concatenate([np.arange(b - a) for a, b in zip(ends, ends[1:])])
