"""Near copies by SimHash and, exactly, by the Jaccard similarity of word shingles.

Texts are first grouped as ``simhash`` groups them, by fingerprints of their ``SHINGLE``-word
shingles that differ in three bits at most, and each text of a component is held against its
first one.  Fingerprints miss similar texts and chain others, so shared shingles complete this:

Texts are sets of 64-bit hashes of ``SHINGLE`` words.  Sets of n and m >= n shingles whose
similarity is s or more have at least 2 s n / (1 + s) and at least s m in common, so the
first n - ceil(2 s n / (1 + s)) + 1 of the shorter and the first m - ceil(s m) + 1 of the longer
share one, in any fixed order of shingles.  A key without a set of the first kind has no
candidates.  The order puts those last that are frequent in a sample of the texts: it decides
how many candidates there are, never the result.  Texts that share a passage and are not
similar have it behind their own words, beyond the shorter prefix, so that the passage is no key.

Only first shingles are exchanged.  Candidates are first held against each other by sketches
of a few bits a shingle (the parity of the shingles of each place): places that differ are
a lower bound of the shingles that do.  Texts of the pairs that are left are compared on whole sets.

A key of two sets is a candidate without any join.  Of a key of more, each set
is first held against one of them, together with the candidates by fingerprint; only sets that are then in different
components are held against each other, so that many near copies of one text
don't meet in pairs.  Under a key of many, those still apart meet by what they differ in from
the one that all were held against (``by_difference``), not by the key: copies with a few changes
too many have most shingles in common.  The components are those of all pairs of similarity s.

Rows: texts of fewer words than a shingle are one shingle.  Null and empty texts
are the empty set, one component.  Repeated rows are one set.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import simhash
from assayer.llm.common import fresh, settle, small_batches
from assayer.llm.components import components
from assayer.session import written

SHINGLE = 5
SIMILARITY = 0.8
#: One text in so many counts for the order of shingles; those in ``OFTEN`` of them or more
#: are frequent, at most ``LISTED``.  Results do not depend on them.
SAMPLED, OFTEN, LISTED = 16, 8, 100_000
#: Sets under one key beyond which those apart meet by their differences.  Results do not depend on it.
LARGE = 128
#: Bits of a sketch at most; longer texts share places, which only weakens the bound.
SKETCH = 1 << 20


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    return np.unique(simhash.hashes(text, shingle).view("<i8"))


def prefix(own: np.ndarray, often: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, int]:
    """The shingles of which similar sets share one, and how many of them count where the
    other set is not shorter; those in ``often`` (ascending) come last."""
    n, s = len(own), Fraction(str(similarity))
    if not n:
        return own, 0
    if len(often):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        own = own[np.argsort(often[at] == own, kind="stable")]
    return own[:n - math.ceil(s * n) + 1], n - math.ceil(2 * s * n / (1 + s)) + 1


def sketch(own: np.ndarray) -> bytes:
    """Parity of the shingles of each place; two places a shingle or more."""
    bits = min(SKETCH, max(64, 1 << (2 * len(own)).bit_length()))
    return np.packbits((np.bincount(own & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing(one: bytes, two: bytes) -> int:
    """At most as many shingles as are in one of two sets only, from their sketches."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def frequent(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Shingles frequent in a sample of the texts, at most ``LISTED``, ascending."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        settle()
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch["text"]]
            kinds, c = np.unique(np.concatenate(sets) if sets else np.zeros(0, "<i8"), return_counts=True)
            yield pd.DataFrame({"s": kinds, "c": c})

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").distinct()
    top = some.mapInPandas(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(
        F.col("c") >= OFTEN).orderBy(F.desc("c"), "s").limit(LISTED)
    return np.sort(np.array([r.s for r in top.collect()], dtype="<i8"))


def _similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar; ``texts``: (sid, text)."""
    least = Fraction(str(similarity))

    @F.pandas_udf("boolean")
    def may_be(one: pd.Series, two: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        # d shingles in one set only: similarity (n + m - d) / (n + m + d)
        return pd.Series([x + y - d >= least * (x + y + d) for d, x, y in zip(map(differing, one, two), n.tolist(), m.tolist())],
                         dtype=bool)

    @F.pandas_udf("boolean")
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        out, last, a = [], None, None
        for x, y in zip(one, two):
            if a is None or x != last:
                last, a = x, shingles(x, shingle)
            b = shingles(y, shingle)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both >= least * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    own = sets.select("sid", "n", "sketch")
    left = pairs.join(own.toDF("a", "m", "one"), "a").join(own.toDF("b", "n", "two"), "b").where(
        may_be("one", "two", "m", "n")).select("a", "b")
    left = written(left, "possible")
    ids = left.select(F.col("a").alias("sid")).union(left.select("b")).distinct()
    whole = written(texts.join(ids, "sid", "left_semi"), "texts")
    return written(left.join(whole.toDF("b", "two"), "b").join(whole.toDF("a", "one"), "a").where(
        alike("one", "two")).select("a", "b"), "similar")


def by_fingerprint(sets: DataFrame, bits: int = simhash.BITS) -> DataFrame:
    """(a, b) with a < b: each set (sid, fp) beside the first of its SimHash component, so
    no more pairs than sets."""
    first = written(sets.groupBy("fp").agg(F.min("sid").alias("first")), "first")
    roots = components(written(simhash.links(first.select("fp"), bits), "links"), "a", "b")
    linked = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    of = linked.join(heads, "root").select("fp", "head")
    return sets.select("sid", "fp").join(of, "fp").where("head < sid").select(F.col("head").alias("a"), F.col("sid").alias("b"))


def by_difference(groups: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(a, b) with a < b: candidates among the sets of each group (base, sid, n, root) that have
    different roots, at least all similar ones.  The base is a set of its group, and the sets
    similar to it have its root.

    w, the difference of a set of n shingles, are those in it or in the base only, d are those in
    one of two sets only: d = w + w' - 2 (shared), and similar sets have d <= r (n + n') with
    r = (1 - s) / (1 + s).  So their differences share some, the first of them, in any fixed order, at
    the place (w - w' + d) / 2 + 1 of w or before.  One of the two is not similar to the base, w' > r (n' + base):
    of the other about the first half of the difference counts.  The order has those last that are in many
    differences of the group, so that copies with changes of their own share none where it counts.
    """
    @F.pandas_udf("array<long>")
    def difference(base: pd.Series, text: pd.Series) -> pd.Series:
        out, last, a = [], None, None
        for x, y in zip(base, text):
            if a is None or x != last:
                last, a = x, shingles(x, shingle)
            out.append(np.setxor1d(a, shingles(y, shingle), assume_unique=True).tolist())
        return pd.Series(out, dtype=object)

    s = float(similarity)
    r = (1 - s) / (1 + s)
    whole = written(texts.join(groups.select("sid").distinct(), "sid", "left_semi"), "texts")
    homes = groups.where("sid = base").select("base", F.col("root").alias("home"), F.col("n").alias("m"))
    pairs = groups.join(homes, "base").join(whole, "sid").join(whole.toDF("base", "one"), "base")
    apart = written(pairs.select("base", "sid", "n", "m", "root", (F.col("root") != F.col("home")).alias("away"),
                                 difference("one", "text").alias("d")), "differences")
    each = apart.select("base", "sid", "n", "m", "root", "away", F.size("d").alias("w"), F.explode("d").alias("e"))
    shared = each.groupBy("base", "e").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("x"), F.max("root").alias("y"))
    order = Window.partitionBy("base", "sid").orderBy("c", "e")
    placed = each.join(shared, ["base", "e"]).withColumn("i", F.row_number().over(order)).where(
        f"x < y AND (i <= (w + {r} * (n - m)) / 2 + 1 + 1e-6 OR away AND i <= {r} * n * {1 + 1 / s} + 1 + 1e-6)")
    placed = written(placed.select("base", "e", "sid", "n", "m", "root", "away", "w", "i"), "places")
    one = placed.where("away").select("base", "e", *[F.col(c).alias(f"{c}_") for c in ("sid", "n", "w", "i", "root")])
    two = placed.where(f"i <= (w + {r} * (n - m)) / 2 + 1 + 1e-6")
    return one.join(two, ["base", "e"]).where(
        f"root_ <> root AND least(n_, n) >= {s} * greatest(n_, n) - 1e-6 AND i_ <= (w_ - w + {r} * (n_ + n)) / 2 + 1 + 1e-6 "
        f"AND i <= (w - w_ + {r} * (n_ + n)) / 2 + 1 + 1e-6").select(
        F.least("sid_", "sid").alias("a"), F.greatest("sid_", "sid").alias("b")).distinct()


def representatives(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """See ``_representatives``; texts reach the Python workers in small batches."""
    with small_batches(docs.sparkSession):
        return _representatives(docs, similarity, shingle)


def _representatives(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the smallest doc_id (null
    last), then the smallest digest of the text; of equal rows any one."""
    if not 0 < similarity <= 1:
        raise ValueError("a similarity above 0 and up to 1")
    rid = fresh("rid", docs.columns)
    rows = written(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, shingle))

    @F.pandas_udf("digest binary, fp long, n int, k int, first array<long>, sketch binary")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        settle()
        for batch in batches:
            prints, sets = [], []
            for text in batch:
                codes = simhash.hashes(text, shingle)
                prints.append(simhash.majority(codes))
                sets.append(np.unique(codes.view("<i8")))
            firsts = [prefix(s, often.value, similarity) for s in sets]
            yield pd.DataFrame({"digest": [hashlib.sha256(s.tobytes()).digest() for s in sets],
                                "fp": np.array(prints, dtype="int64"),
                                "n": np.array([len(s) for s in sets], dtype="int32"),
                                "k": np.array([k for _, k in firsts], dtype="int32"),
                                "first": [f.tolist() for f, _ in firsts], "sketch": [sketch(s) for s in sets]})
            del batch, sets, firsts
        settle()

    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                     F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"), F.col(rid).alias("sid"))
    each = rows.select(order.alias("best"), signed("text").alias("x")).select("best", "x.*")
    # equal sets may repeat their shingles differently
    sets = each.groupBy("digest").agg(F.min("best").alias("best"), F.min("fp").alias("fp"),
                                      *[F.first(c).alias(c) for c in ("n", "k", "first", "sketch")])
    sets = written(sets.select("best.sid", "best", "fp", "n", "k", "first", "sketch"), "distinct")
    texts = rows.select(F.col(rid).alias("sid"), "text")

    keyed = sets.select("sid", "n", "k", F.posexplode("first").alias("i", "s")).select(
        "sid", "n", "s", (F.col("i") < F.col("k")).alias("short"))
    # one exchange of narrow rows serves the counts and the members of the keys
    dealt = keyed.repartition("s")
    sums = dealt.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min(F.when(F.col("short"), F.col("sid"))).alias("centre"),
                                  F.min("n").alias("m"), F.max("n").alias("most"))
    near = f"least(m, n) >= {float(similarity)} * greatest(m, n) - 1e-6"
    kept = sums.where(f"c > 2 AND centre IS NOT NULL OR c = 2 AND centre IS NOT NULL AND m >= {float(similarity)} * most - 1e-6")
    member = written(dealt.join(kept.select("s", "c", "centre"), "s"), "members")
    centre = member.where("sid = centre").select("s", F.col("n").alias("m"))
    star = member.join(centre, "s").where("sid <> centre").where(near).select(
        F.least("centre", "sid").alias("a"), F.greatest("centre", "sid").alias("b"))
    member = member.where("c > 2").drop("c")
    tried = written(by_fingerprint(sets).union(star).distinct(), "tried")
    links = _similar(tried, sets, texts, similarity, shingle)
    roots = components(links, "a", "b")
    # what is still apart under one key
    placed = member.join(roots, member.sid == roots.node, "left").select(
        "s", "sid", "n", "short", "centre", F.coalesce("root", "sid").alias("root"))
    apart = placed.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("c")).where(
        "x < y").select("s", "c")
    open_ = written(placed.join(apart, "s"), "apart")
    few = open_.where(F.col("c") <= LARGE)
    one = few.where("short").select("s", F.col("sid").alias("p"), F.col("n").alias("m"), F.col("root").alias("x"))
    two = few.select("s", F.col("sid").alias("q"), "n", F.col("root").alias("y"))
    rest = one.join(two, "s").where(f"x <> y AND m <= n AND {near}").select(
        F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    groups = written(open_.where(F.col("c") > LARGE).select(F.col("centre").alias("base"), "sid", "n", "root").distinct(), "groups")
    if not groups.isEmpty():
        rest = rest.union(by_difference(groups, texts, similarity, shingle))
    rest = rest.distinct()
    more = _similar(written(rest.join(tried, ["a", "b"], "left_anti"), "rest"), sets, texts, similarity, shingle)
    roots = components(links.union(more), "a", "b")
    linked = sets.select("sid", "best").join(roots, sets.sid == roots.node, "left").select(
        "best", F.coalesce("root", "sid").alias("root"))
    chosen = linked.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.sid").alias(rid))
    return rows.join(chosen, rid, "left_semi").select(*docs.columns)
