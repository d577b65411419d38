"""Byte-level BPE as a finite-state transducer, and its streaming inverse.

A sequence of tokens is the BPE encoding of its bytes exactly if every two
neighbours are what the merges make of their own bytes.  So a transducer over
bytes can be written down: a configuration is the last token and the place in
the trie of tokens reached since.  Reading a byte moves every configuration
along the trie; where a token ends that may follow the last one, there is a
configuration behind that token, and for every prefix exactly one.
``Transducer`` determinises this lazily: the set of configurations is a state,
made when a text first leads to it, and holds the last token of its prefix.
Tokens leave when all configurations agree on them, which lie no further apart
than the longest token.

Rows: one result per input row, repeated rows included.  A null or empty text
has no ids and decodes to the empty text.  Other columns pass through untouched.
The vocabulary (a file of fixed size) is the only broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import kept, settle, slices

ROOT = 0
#: Bytes after which what is certain leaves, at the latest.
LOOKAHEAD = 1024
#: Tokens below a place in the trie that a configuration lists instead of the last token.
FEW = 8
#: Entries after which a task forgets what it has memorised.  Results do not depend on it.
MEMO_STATES = 100_000
MEMO_PAIRS = 500_000
MEMO_WORDS = 120_000
#: Characters of the texts whose ids and decoded texts a task holds at once.
SLICE = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class Transducer:
    """Lazily determinised transducer from bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        self.children: list[dict[int, int]] = [{}]
        self.ends, self.depth = [-1], [0]
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1 or self._split(token, rank):
                self._insert(token, rank)
        #: Tokens further down, where they are few: there what may follow stands for the last token.
        self.below: list[tuple[int, ...] | None] = [None] * len(self.children)
        for node in reversed(range(len(self.children))):
            kids = self.children[node].values()
            if all(self.below[k] is not None for k in kids):
                few = [t for k in kids for t in (*self.below[k], self.ends[k]) if t >= 0]
                self.below[node] = tuple(few) if len(few) <= FEW else None
        self.forget()

    def forget(self) -> None:
        self.pairs: dict[tuple[int, int], bool] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, int]] = []
        self.last: list[int] = []
        self._state(((-1, ROOT),), -1)

    def _state(self, configurations: tuple, last: int) -> int:
        known = self.ids.get(configurations)
        if known is None:
            known = self.ids[configurations] = len(self.states)
            self.states.append(configurations)
            self.moves.append({})
            self.last.append(last)
        return known

    def _insert(self, token: bytes, rank: int) -> None:
        node = ROOT
        for b in token:
            if b not in self.children[node]:
                self.children[node][b] = len(self.children)
                self.children.append({})
                self.ends.append(-1)
                self.depth.append(self.depth[node] + 1)
            node = self.children[node][b]
        self.ends[node] = rank

    def _split(self, token: bytes, rank: int) -> bool:
        """Record the last merge of a token; false if merges never make it."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if self.ranks.get(parts[best] + parts[best + 1], 1 << 60) >= 1 << 60:
                return False
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        self.parts[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return True

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The pieces at one edge of a token while it is merged, last first, each
        with the rank of the merge that makes it and of the one that ends it."""
        found = self.spines.get((token, side))
        if found is None:
            found, piece, until = [], token, float("inf")
            while True:
                since = piece if piece in self.parts else -1
                found.append((piece, since, until))
                if since < 0:
                    break
                until, piece = piece, self.parts[piece][side]
            self.spines[token, side] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """True if merging the bytes of both tokens gives these two tokens: no merge
        across their border comes before the merges that use up its two sides.  Of
        equal merges the one further left comes first."""
        if left < 0:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            known = True
            a, b, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
            while True:
                (p, p_since, p_until), (q, q_since, q_until) = a[i], b[j]
                merged = self.ranks.get(self.tokens[p] + self.tokens[q])
                if merged is not None and merged < p_until and merged <= q_until:
                    known = False
                    break
                if p_since < 0 and q_since < 0:
                    break
                if p_since > q_since:
                    i += 1
                elif q_since > p_since:
                    j += 1
                else:
                    # both sides are made by equal merges: the left one is made first
                    j += 1
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _move(self, state: int, byte: int) -> int:
        after, whole = [], -1
        for last, node in self.states[state]:  # last: a token, or the tokens that may still come
            child = self.children[node].get(byte)
            if child is None:
                continue
            listed = type(last) is tuple
            token = self.ends[child]
            if token >= 0 and (token in last if listed else self.may_follow(last, token)):
                whole = token
            if self.children[child]:
                below = self.below[child]
                if below is not None:
                    last = tuple([t for t in below if (t in last if listed else self.may_follow(last, t))])
                    if not last:
                        continue
                after.append((last, child))
        if whole < 0:
            raise ValueError("these ranks are not those of a byte-level BPE")
        after.append((whole, ROOT))
        found = self.moves[state][byte] = self._state(tuple(after), whole)
        return found

    def _back(self, lasts: list[int], at: int, out: list[int]) -> None:
        """Append the tokens of the first ``at`` bytes."""
        tokens = []
        while at:
            tokens.append(lasts[at - 1])
            at -= self.size[tokens[-1]]
        out.extend(reversed(tokens))

    def _certain(self, lasts: list[int], state: int) -> int:
        """Bytes up to which all configurations agree on the tokens."""
        starts = sorted({len(lasts) - self.depth[node] for _, node in self.states[state]})
        at = starts[0]
        for start in starts[1:]:
            while start != at:
                if start > at:
                    start -= self.size[lasts[start - 1]]
                else:
                    at -= self.size[lasts[at - 1]]
        return at

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece of text.  A piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, lasts = 0, []
        for begin in range(0, len(piece), LOOKAHEAD):
            if begin:
                sure = self._certain(lasts, state)
                self._back(lasts, sure, out)
                del lasts[:sure]
            if len(self.states) > MEMO_STATES:
                here, last = self.states[state], self.last[state]
                self.forget()
                state = self._state(here, last)
            moves, last = self.moves, self.last
            for byte in piece[begin:begin + LOOKAHEAD]:
                step = moves[state].get(byte)
                state = self._move(state, byte) if step is None else step
                lasts.append(last[state])
        self._back(lasts, len(lasts), out)
        return out


class Words(dict):
    """Memo of packed ids by piece of text.  When it is full, only what is used
    again before it fills once more stays."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.older = dict(self)
            self.clear()
        packed = self.older.get(word)
        if packed is None:
            packed = np.array(self.machine.encode(word.encode()), dtype="<u4").tobytes()
        if len(word) <= 64:
            self[word] = packed
        return packed


#: Lead bytes of UTF-8: bytes that follow, and the range of the next one.
LEADS = {**{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}, **{b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)},
         **{b: (3, 0x80, 0xBF) for b in range(0xF0, 0xF5)},
         0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}


class Utf8Machine:
    """Incremental UTF-8 decoder.  Its state is the character begun, the bytes it
    still lacks and the range of the next one; what can't be a character becomes U+FFFD."""

    def __init__(self) -> None:
        self.begun = b""
        self.lacks, self.low, self.high = 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.lacks:
                if self.low <= b <= self.high:
                    self.begun += bytes((b,))
                    self.lacks, self.low, self.high = self.lacks - 1, 0x80, 0xBF
                    if not self.lacks:
                        out.append(self.begun.decode())
                        self.begun = b""
                    continue
                out.append(self.close())
            if b < 0x80:
                out.append(chr(b))
            elif b in LEADS:
                self.begun, (self.lacks, self.low, self.high) = bytes((b,)), LEADS[b]
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        """End of the stream: a character begun can't be completed."""
        cut, self.begun, self.lacks = bool(self.lacks), b"", 0
        return "�" if cut else ""


class Decoder:
    """Ids back to text, token by token."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.data: list[bytes] = [b""] * size
        self.text: list[str | None] = [None] * size
        for token, rank in ranks.items():
            self.data[rank] = token
            try:
                self.text[rank] = token.decode()
            except UnicodeDecodeError:
                pass
        self.split = np.array([t is None for t in self.text], dtype=bool)

    def stream(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text as it becomes certain, chunk by chunk; chunks may end inside a character."""
        machine, text, data = Utf8Machine(), self.text, self.data
        for ids in chunks:
            if not machine.lacks and not self.split[ids].any():
                yield "".join([text[i] for i in ids.tolist()])
                continue
            out = []
            for i in ids.tolist():
                whole = text[i]
                out.append(whole if whole is not None and not machine.lacks else machine.feed(data[i]))
            yield "".join(out)
        yield machine.close()

    def decode(self, packed: bytes | None, chunk: int = 65_536) -> str:
        ids = np.frombuffer(packed or b"", dtype="<u4")
        return "".join(self.stream(ids[i:i + chunk] for i in range(0, len(ids), chunk)))


def _once(kind, broadcast):
    """One compiled machine a worker process, for the vocabulary used last."""
    key = f"{kind.__name__}-{broadcast.value[0]}"
    if key not in kept:
        for old in [k for k in kept if k.startswith(kind.__name__)]:
            del kept[old]
        kept[key] = kind(broadcast.value[1])
    return kept[key]


def vocabulary(spark, path: str):
    """The ranks of a file as a broadcast; its size is that of the file."""
    return spark.sparkContext.broadcast((path, read_ranks(path)))


def encode_documents(docs: DataFrame, vocab, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with a binary column of ids: little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is encoded separately; special tokens are ordinary
    text.  A column named ``into`` is replaced.
    """
    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(_once(Transducer, vocab))
        find = regex.compile(pattern).findall
        for batch in batches:
            yield pd.Series([b"".join([words[w] for w in find(t)]) if t else b"" for t in batch],
                            dtype=object)

    return docs.withColumn(into, encode(F.col(text)))


def round_trip(docs: DataFrame, vocab, pattern: str, text: str = "text", into: str = "coded") -> DataFrame:
    """``docs`` with a struct of ids and of the text decoded from them, made in one pass."""
    @F.pandas_udf("ids binary, decoded string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, machine = Words(_once(Transducer, vocab)), _once(Decoder, vocab)
        find = regex.compile(pattern).findall
        for batch in batches:
            for a, b in slices(batch.tolist(), SLICE):
                ids = [b"".join([words[w] for w in find(t)]) if t else b"" for t in batch.iloc[a:b]]
                yield pd.DataFrame({"ids": ids, "decoded": [machine.decode(i) for i in ids]}, dtype=object)
        batch = ids = None
        settle(forget=False)

    return docs.withColumn(into, code(F.col(text)))


def decode_documents(docs: DataFrame, vocab, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of a binary column of ids (see ``encode_documents``)."""
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _once(Decoder, vocab)
        for batch in batches:
            yield pd.Series([machine.decode(b) for b in batch], dtype=object)

    return docs.withColumn(into, decode(F.col(ids)))


def digests(coded: DataFrame, ids: str = "coded.ids", decoded: str = "coded.decoded", keep_ids: bool = False) -> DataFrame:
    """Token count and digests of ids and of decoded text, and on demand the ids (little-endian, four bytes each)."""
    return coded.select("doc_id", (F.length(ids) / 4).cast("long").alias("n_tokens"),
                        F.sha2(F.col(ids), 256).alias("ids_sha256"),
                        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
                        *([F.col(ids).alias("ids")] if keep_ids else []))
