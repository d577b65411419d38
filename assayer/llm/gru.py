"""Language-model scoring by a gated recurrent network with a class-factored softmax.

The vocabulary of the network is a fixed number of symbols: an end of text, the
most frequent words of the training documents, and buckets that share all other
words by their last two bytes.  A symbol belongs to a class of equal size, and its probability is that of its class times that
within the class; a word of a bucket is then drawn by its smoothed count.  The
probability of a text is the product over all its tokens and the end.

Word counts cover every training document: tasks count, one exchange adds up.
The network is trained on every training document once, in rounds: each task
trains a copy on its share of the round by truncated backpropagation, and the copies are averaged by
weight of their tokens; per chunk of parameters, in the tasks.  In scoring the
state of a text is carried across windows from its first to its last token.

Counts of the ``LISTED`` most frequent words go to all tasks; those of rarer
words are joined by word, so nothing is left out.

Rows: one result per input row, repeated rows included.  A null or empty text is
one end token.  A null doc_id counts as the empty text in the folds.  Without
training documents all counts are zero and the network is the one it starts
from.  Long runs and long texts are cut into windows, never shortened.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import LOWER, in_slices, remainder5
from assayer.session import written

HIDDEN = 16
CLASSES = 32
MEMBERS = 32
BUCKETS = 63
SYMBOLS = CLASSES * MEMBERS
END = BUCKETS
#: The end of a text in the table of counts; words hold no white space.
END_WORD = "\n"
LISTED = 200_000
LANES, STEPS = 256, 16
#: Scoring has no order to keep: more lanes, as many tokens at a time.
SCORE_LANES, SCORE_STEPS = 1024, 16
RATE = 0.08
#: Shares of the training documents by round; together all of them.
ROUNDS = (0.125, 0.375, 0.5)
CHUNK = 1024
_HELD = 1


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


def words_of_all(texts: Sequence[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has; as ``words_of``
    splits them, without an object for every word."""
    lines = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string()).fill_null("")))
    lists = pc.ascii_split_whitespace(lines)
    sizes = np.where(pc.equal(lines, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy())
    words = lists.flatten()
    return words.filter(pc.not_equal(words, "")), sizes


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


class Network:
    """Parameters, forward and backward passes.  Symbols come as (steps, lanes)."""

    SHAPES = {"inputs": (SYMBOLS, 3 * HIDDEN), "state": (HIDDEN, 3 * HIDDEN), "classes": (HIDDEN, CLASSES),
              "class_bias": (CLASSES,), "members": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS)}

    def __init__(self, mass: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        share = mass.reshape(CLASSES, MEMBERS) + 0.5
        self.p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in self.SHAPES.items()}
        self.p["class_bias"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        self.p["member_bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        self.g = {k: np.full(s, 1e-3, dtype=np.float32) for k, s in self.SHAPES.items()}

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for d in (self.p, self.g) for x in d.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for d in (self.p, self.g):
            for k, s in self.SHAPES.items():
                n = math.prod(s)
                d[k] = flat[at:at + n].reshape(s).astype(np.float32)
                at += n
        return self

    def states(self, x: np.ndarray, h: np.ndarray, keep_all: bool = False):
        """States before each token, the state behind, and what the backward pass needs."""
        steps, lanes = x.shape
        k = HIDDEN
        # a sigmoid is half of the tanh of a half, and a half: the weights are halved once
        half = np.repeat(np.array([0.5, 0.5, 1], dtype=np.float32), k)
        a, u_all = (self.p["inputs"] * half)[x], self.p["state"] * half
        ended = x == END
        ends = ended.any(axis=1).tolist()
        before = np.empty((steps, lanes, k), dtype=np.float32)
        # what a step leaves, of all steps or of one
        rows = steps if keep_all else 1
        gates, new, old = (np.empty((rows, lanes, w), dtype=np.float32) for w in (2 * k, k, k))
        for t in range(steps):
            before[t] = h
            u = h @ u_all
            g, n = gates[t % rows], new[t % rows]
            np.add(a[t, :, :2 * k], u[:, :2 * k], out=g)
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            if keep_all:
                old[t] = u[:, 2 * k:]
            np.multiply(g[:, k:], u[:, 2 * k:], out=n)
            n += a[t, :, 2 * k:]
            np.tanh(n, out=n)
            h = h - n
            h *= g[:, :k]
            h += n
            if ends[t]:
                h[ended[t]] = 0
        return before, h, (gates[:, :, :k], gates[:, :, k:], new, old), (ended, ends)

    def log_probability(self, before: np.ndarray, x: np.ndarray, grads: dict | None = None):
        """log P of each token given the state before it.  With ``grads`` it also adds the
        gradients of the softmaxes there and returns that of the states."""
        flat, target = before.reshape(-1, HIDDEN), x.ravel()
        cls, member = target // MEMBERS, target % MEMBERS
        rows = np.arange(len(target))
        e = flat @ self.p["classes"] + self.p["class_bias"]
        np.minimum(e, 60, out=e)
        out = e[rows, cls]
        np.exp(e, out=e)
        total = e @ np.ones(CLASSES, dtype=e.dtype)  # short rows are added up faster as a product
        out = out - np.log(total)
        back = None
        if grads is not None:
            e /= total[:, None]
            e[rows, cls] -= 1
            grads["classes"] = flat.T @ e
            grads["class_bias"] = e.sum(axis=0)
            back = e @ self.p["classes"].T
            grads["members"], grads["member_bias"] = np.zeros((CLASSES, HIDDEN, MEMBERS), np.float32), np.zeros(
                (CLASSES, MEMBERS), np.float32)
        order = np.argsort(cls.astype(np.int16), kind="stable")  # short numbers are sorted by radix
        cuts = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))]).tolist()
        own = [c for c in range(CLASSES) if cuts[c] < cuts[c + 1]]
        # sorted by class once, so that only the products go class by class
        h, m = flat[order], member[order]
        e = np.empty((len(order), MEMBERS), dtype=h.dtype)
        for c in own:
            part = e[cuts[c]:cuts[c + 1]]
            np.matmul(h[cuts[c]:cuts[c + 1]], self.p["members"][c], out=part)
            part += self.p["member_bias"][c]
        np.minimum(e, 60, out=e)
        picked = e[rows, m]
        np.exp(e, out=e)
        total = e @ np.ones(MEMBERS, dtype=e.dtype)
        out[order] += picked - np.log(total)
        if grads is not None:
            e /= total[:, None]
            e[rows, m] -= 1
            behind = np.empty_like(h)
            grads["member_bias"][own] = np.add.reduceat(e, [cuts[c] for c in own], axis=0)
            for c in own:
                at = slice(cuts[c], cuts[c + 1])
                grads["members"][c] = h[at].T @ e[at]
                np.matmul(e[at], self.p["members"][c].T, out=behind[at])
            back[order] += behind
        return out.reshape(x.shape), None if back is None else back.reshape(before.shape)

    def learn(self, x: np.ndarray, h: np.ndarray, rate: float = RATE) -> np.ndarray:
        """One step of truncated backpropagation; the state behind the window."""
        steps, lanes = x.shape
        before, last, (z, r, n, old), (ended, ends) = self.states(x, h, True)
        grads: dict[str, np.ndarray] = {}
        _, out = self.log_probability(before, x, grads)
        k, state = HIDDEN, self.p["state"]
        da = np.empty((steps, lanes, 3 * k), dtype=np.float32)
        du = np.empty((steps, lanes, 3 * k), dtype=np.float32)
        dh = np.zeros((lanes, k), dtype=np.float32)
        # factors of all steps at once; only what follows from step to step is in the loop
        rest = 1 - z
        by_z, by_n, by_r = (before - n) * z * rest, rest * (1 - n * n), old * r * (1 - r)
        for t in range(steps - 1, -1, -1):
            if ends[t]:
                dh[ended[t]] = 0
            now, to_state = da[t], du[t]
            dn = dh * by_n[t]
            np.multiply(dh, by_z[t], out=now[:, :k])
            np.multiply(dn, by_r[t], out=now[:, k:2 * k])
            now[:, 2 * k:] = dn
            to_state[:, :2 * k] = now[:, :2 * k]
            np.multiply(dn, r[t], out=to_state[:, 2 * k:])
            dh *= z[t]
            dh += to_state @ state.T
            dh += out[t]
        grads["state"] = before.reshape(-1, k).T @ du.reshape(-1, 3 * k)
        scale = np.float32(1 / x.size)
        for name, g in grads.items():
            self._step(name, slice(None), g * scale, rate)
        flat = x.ravel()
        order = np.argsort(flat.astype(np.int16), kind="stable")
        count = np.bincount(flat, minlength=SYMBOLS)
        used = np.flatnonzero(count)
        first = np.cumsum(count[used]) - count[used]
        self._step("inputs", used, np.add.reduceat(da.reshape(-1, 3 * k)[order], first, axis=0) * scale, rate)
        return last

    def _step(self, name: str, rows, g: np.ndarray, rate: float) -> None:
        sums = self.g[name][rows] + g * g
        self.g[name][rows] = sums
        self.p[name][rows] -= np.float32(rate) * g / np.sqrt(sums)


class Vocabulary:
    """The listed words: symbol and count of each, and the sums of the buckets."""

    def __init__(self, listed: list[tuple[bytes, int]], sums: dict[int, tuple[int, int]], tokens: int, kinds: int,
                 ends: int):
        """listed: by falling count; sums: tokens and kinds of all words by bucket."""
        self.tokens, self.kinds = tokens, kinds
        self.words = pa.array([w.decode() for w, _ in listed], pa.large_string())
        self.count = np.array([*(c for _, c in listed), ends], dtype=np.int64)  # the last one is the end
        own = min(len(listed), SYMBOLS - BUCKETS - 1)
        self.symbol = np.array([*range(BUCKETS + 1, BUCKETS + 1 + own), *(bucket(w) for w, _ in listed[own:]), END],
                               dtype=np.int32)
        left = np.array([sums.get(b, (0, 0)) for b in range(BUCKETS)], dtype=np.int64).reshape(BUCKETS, 2)
        for w, c in listed[:own]:
            left[bucket(w)] -= (c, 1)
        mass = np.zeros(SYMBOLS)
        mass[:BUCKETS], mass[END] = left[:, 0], ends
        mass[BUCKETS + 1:BUCKETS + 1 + own] = [c for _, c in listed[:own]]
        self.mass = mass
        #: log10 of what a count plus one half is divided by within a bucket.
        self.log_bucket = np.log10(left[:, 0] + 0.5 * (left[:, 1] + 1))
        self.log_all = math.log10(tokens + 0.5 * (kinds + 1))

    def codes(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """Number of each token (a rare word: minus one minus its bucket), end included; rare words."""
        return self.codes_of_all([text])[0]

    def codes_of_all(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, list[bytes]]]:
        """``codes`` of each text; all words are looked up at once."""
        words, sizes = words_of_all(texts)
        found = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        missing = np.flatnonzero(found < 0)
        rare = [w.encode() for w in words.take(pa.array(missing)).to_pylist()]
        behind = np.cumsum(sizes)
        codes = np.full(len(found) + len(sizes), len(self.count) - 1, dtype=np.int32)
        place = np.arange(len(found)) + np.repeat(np.arange(len(sizes)), sizes)  # an end behind each text before
        codes[place] = found
        codes[place[missing]] = [-1 - bucket(w) for w in rare]
        cuts = np.searchsorted(missing, behind).tolist()
        return [(c, rare[a:b]) for c, a, b in zip(
            np.split(codes, (behind + np.arange(1, len(sizes) + 1))[:-1]), [0, *cuts], cuts)] if len(sizes) else []

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < 0, -1 - codes, self.symbol[np.maximum(codes, 0)])


def train_copy(net: Network, vocabulary: Vocabulary, texts: Iterator[list[str | None]]) -> int:
    """Train in place; the number of tokens.  Texts follow each other in lanes that
    keep their state from window to window; an end sets it back."""
    state, seen, rest = np.zeros((LANES, HIDDEN), dtype=np.float32), 0, 0
    held, size = [], LANES * STEPS * 64

    def run(stream: np.ndarray) -> None:
        nonlocal state
        lanes = stream.reshape(LANES, -1).T
        for t in range(0, len(lanes), STEPS):
            state = net.learn(np.ascontiguousarray(lanes[t:t + STEPS]), state)
        state = np.zeros_like(state)

    for batch in texts:
        for codes, _ in vocabulary.codes_of_all(batch):
            held.append(vocabulary.symbols(codes))
            seen += len(held[-1])
            rest += len(held[-1])
            if rest >= size:
                stream = np.concatenate(held)
                while len(stream) >= size:
                    run(stream[:size])
                    stream = stream[size:]
                held, rest = [stream], len(stream)
    stream = np.concatenate(held) if held else np.zeros(0, dtype=np.int32)
    if len(stream):  # the end of the share: fewer steps, the last lanes filled up with ends
        need = LANES * -(-len(stream) // LANES)
        run(np.concatenate([stream, np.full(need - len(stream), END, dtype=stream.dtype)]))
    return seen


def score_texts(net: Network, symbols: list[np.ndarray], window: int = SCORE_STEPS) -> np.ndarray:
    """log10 probability of each sequence of symbols that ends with the end."""
    lanes = max(1, min(SCORE_LANES, len(symbols)))
    load, where = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in sorted(range(len(symbols)), key=lambda i: -len(symbols[i])):
        n, k = heapq.heappop(load)
        where[k].append(i)
        heapq.heappush(load, (n + len(symbols[i]), k))
    rows = sorted(((sum(len(symbols[i]) for i in own), own) for own in where), key=lambda r: -r[0])
    longest = rows[0][0] if rows else 0
    x = np.full((longest, lanes), END, dtype=np.int32)
    out = np.zeros(len(symbols))
    for k, (n, own) in enumerate(rows):
        if own:
            x[:n, k] = np.concatenate([symbols[i] for i in own])
    sizes = np.array([n for n, _ in rows])
    logs = np.zeros((longest, lanes), dtype=np.float32)
    h = np.zeros((lanes, HIDDEN), dtype=np.float32)
    for t in range(0, longest, window):
        on = int(np.searchsorted(-sizes, -t))  # lanes that still have tokens
        part = np.ascontiguousarray(x[t:t + window, :on])
        before, h, _, _ = net.states(part, h[:on])
        logs[t:t + window, :on] = net.log_probability(before, part)[0]
    for k, (_, own) in enumerate(rows):
        at = 0
        for i in own:
            out[i] = logs[at:at + len(symbols[i]), k].sum(dtype=np.float64)
            at += len(symbols[i])
    return out / math.log(10)


def word_counts(docs: DataFrame, text: str = "text", most: int = 300_000) -> DataFrame:
    """(word, bucket, c) over whole texts; the end of text is a word of its own."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def flush():
            return pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "bucket": [bucket(w.encode()) for w in seen],
                                 "c": list(seen.values())})

        for batch in in_slices(batches, "text", lambda part: part):
            kinds = pc.value_counts(words_of_all(batch["text"].tolist())[0])
            seen.update(dict(zip(kinds.field(0).to_pylist(), kinds.field(1).to_pylist())))
            seen[END_WORD] += len(batch)
            if len(seen) > most:
                yield flush()
                seen.clear()
        yield flush()

    return docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, bucket int, c long").groupBy(
        "word", "bucket").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, listed: int = LISTED) -> Vocabulary:
    """From a written table of counts.  The words listed are those above a count that at
    most ``listed`` words reach, so that their number is bounded before they are fetched."""
    words = counts.where(F.col("word") != END_WORD)
    ends = counts.where(F.col("word") == END_WORD).agg(F.sum("c")).first()[0] or 0
    sums = {r.bucket: (r.c, r.n) for r in words.groupBy("bucket").agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    # octaves first, then single counts of the octave in which the list ends
    octaves = words.groupBy(F.floor(F.log2("c")).alias("o")).count().orderBy(F.desc("o")).collect()
    total, least = 0, 1
    for r in octaves:
        if total + r["count"] > listed:
            least = 2 ** (r.o + 1)
            inside = words.where(F.col("c").between(2 ** r.o, 2 ** (r.o + 1) - 1)).groupBy("c").count()
            for s in inside.orderBy(F.desc("c")).limit(listed).toLocalIterator():
                if total + s["count"] > listed:
                    break
                total, least = total + s["count"], s.c
            break
        total += r["count"]
    top = words.where(F.col("c") >= least).select("word", "c").collect() if total else []
    rows = sorted(((r.word.encode(), r.c) for r in top), key=lambda x: (-x[1], x[0]))
    tokens = sum(c for c, _ in sums.values()) + ends
    return Vocabulary(rows, sums, tokens, sum(n for _, n in sums.values()) + bool(ends), ends)


def train(docs: DataFrame, vocab: Vocabulary, rounds=ROUNDS, text: str = "text") -> Network:
    """The network after all rounds over ``docs``."""
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(vocab)
    net, since = Network(vocab.mass), 0.0
    place = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 20)) / float(1 << 20)
    for share in rounds:
        now = spark.sparkContext.broadcast(net.vector())

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Network(words.value.mass).load(now.value)
            n = train_copy(own, words.value, (b["text"].tolist() for b in in_slices(batches, "text", lambda part: part)))
            if n:
                flat = own.vector()
                yield pd.DataFrame({"chunk": range(0, len(flat), CHUNK), "n": n,
                                    "part": [flat[i:i + CHUNK].tobytes() for i in range(0, len(flat), CHUNK)]})

        def average(copies: pd.DataFrame) -> pd.DataFrame:
            parts = np.stack([np.frombuffer(p, dtype=np.float32) for p in copies["part"]])
            weight = copies["n"].to_numpy(dtype=np.float64)
            mean = (weight[:, None] * parts).sum(axis=0) / weight.sum()
            return pd.DataFrame({"chunk": [copies["chunk"].iloc[0]], "part": [mean.astype(np.float32).tobytes()]})

        own = docs.where((place >= since) & (place < since + share)).select(F.col(text).alias("text"))
        copies = own.mapInPandas(learn, "chunk int, n long, part binary")
        mean = copies.groupBy("chunk").applyInPandas(average, "chunk int, part binary").collect()
        if mean:  # as many chunks as the network has, whatever the corpus
            net.load(np.concatenate([np.frombuffer(r.part, dtype=np.float32) for r in sorted(mean)]))
        since += share
    return net


def score(docs: DataFrame, vocab: Vocabulary, net: Network, counts: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of ``docs``."""
    spark = docs.sparkSession
    words, flat = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(net.vector())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = words.value
        model = Network(own.mass).load(flat.value)
        logs = np.log10(own.count + 0.5)
        for batch in in_slices(batches, "text", lambda part: part, 24_000_000):
            coded = own.codes_of_all(batch["text"].tolist())
            symbols = [own.symbols(c) for c, _ in coded]
            total = score_texts(model, symbols)
            base, known = np.zeros(len(coded)), np.zeros(len(coded), dtype=np.int64)
            for i, ((codes, _), s) in enumerate(zip(coded, symbols)):
                listed = codes[codes >= 0]
                base[i], known[i] = logs[listed].sum(), np.count_nonzero(own.count[listed])
                shared = s < BUCKETS
                total[i] += logs[codes[shared & (codes >= 0)]].sum() - own.log_bucket[s[shared]].sum()
            yield pd.DataFrame({"rid": batch["rid"], "doc_id": batch["doc_id"], "n_tokens": [len(s) for s in symbols],
                                "known": known, "base": base, "total": total,
                                "rare": [[w.decode() for w in r] for _, r in coded]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    # ids travel as text: beside a null, pandas would make doubles of them
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("string"), F.col(text).alias("text"))
    first = written(own.mapInPandas(run, "rid long, doc_id string, n_tokens long, known long, base double, total double, "
                                         "rare array<string>").withColumn("doc_id", F.col("doc_id").cast(kind)), "scored")
    rare = first.select("rid", F.explode("rare").alias("word")).join(counts.select("word", "c"), "word", "left").groupBy(
        "rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.count("c").alias("more"))
    return first.drop("rare").join(rare, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(vocab.log_all)).alias("base_score"),
        (F.col("total") + F.coalesce("logs", F.lit(0.0))).alias("score"))


def report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    learned = docs.where(remainder5(F.col("doc_id")) != _HELD)
    counts = written(word_counts(learned), "counts")
    vocab = vocabulary(counts)
    rows = score(docs, vocab, train(learned, vocab), counts)
    return rows.select("doc_id", (remainder5(F.col("doc_id")) == _HELD).alias("held_out"), "n_tokens", "n_known",
                       F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
