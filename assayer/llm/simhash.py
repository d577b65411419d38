"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in three bits at most have, of two halves, one that
differs in one bit at most.  So each half is indexed as it is and with each of
its bits deleted: two halves meet under the same key exactly if they are equal,
or equal but for that bit.  Keys are counted first with fixed-size aggregates;
a key of two fingerprints is a pair without any join.  Keys of more are joined,
and keys of more than ``BUCKET`` are cut further by the same rule within the
half that is still open, until at most 8 bits are open and a key can hold no
more than 2,048 fingerprints.  Every pair found is verified.

Rows: equal texts share a fingerprint and meet nothing again.  A null or empty
text has the fingerprint zero, linked like any other.  A null doc_id belongs to
its component but never names it, unless no row there has an id.  Repeated rows
come out as often as they come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import LOWER, fresh
from assayer.llm.components import components
from assayer.session import written

SHINGLE = 3
BITS = 3
SEED = 42
#: Fingerprints under one key beyond which the key is refined.  Results do not depend on it.
BUCKET = 1024
#: A fingerprint of more than this share (one in so many) of the rows is joined by broadcast.
HOT = 1000


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned hashes of the shingles in their order, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype="<u8")
    behind = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], behind[:-1]])[:len(words) - shingle + 1].tolist()
    return np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (behind[shingle - 1:] - 1).tolist())],
                    dtype="<u8")


def majority(codes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed integer."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(codes), 65_536):
        part = np.unpackbits(codes[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(part, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(codes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, as a signed integer."""
    return majority(hashes(text, shingle))


def with_fingerprints(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t) for t in batch], dtype="int64")

    return docs.withColumn(into, prints(F.col(text)))


def _keys(rows: DataFrame, width: int) -> DataFrame:
    """Keys of both halves of the ``width`` open bits that begin at bit ``low``: the half
    as it is (bit null) and with each bit deleted.  ``key`` carries what agreed before."""
    half = width // 2
    mask = (1 << half) - 1
    sides = F.array(*[F.struct((F.col("low") + a).alias("at"), (F.col("low") + b).alias("rest"))
                      for a, b in ((0, half), (half, 0))])
    cut = rows.select("fp", "key", F.inline(sides)).withColumn("part", F.expr(f"shiftrightunsigned(fp, at) & {mask}L"))
    return cut.select("fp", "key", "at", "rest", "part", F.explode(
        F.sequence(F.lit(-1), F.lit(half - 1))).alias("gone")).select(
        "fp", F.expr("CASE WHEN gone < 0 THEN NULL ELSE shiftright(part, gone) & 1L END").alias("bit"),
        F.col("rest").alias("low"),
        F.expr("xxhash64(key, at, gone, CASE WHEN gone < 0 THEN part ELSE part & ~shiftleft(1L, gone) END)").alias("key"))


def links(prints: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct values of ``fp`` that differ in 1 to
    ``bits`` (3 at most) bits, once each."""
    if not 1 <= bits <= 3:
        raise ValueError("halves promise one differing bit only up to three")
    # a fingerprint becomes 66 keys: dealt out first, so that the few bytes of fingerprints
    # are not made into keys by a few tasks (by another hash, or it would be optimised away)
    dealt = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    rows = dealt.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("low"))
    pairs, width = [], 64
    while True:
        keyed = _keys(rows, width)
        sums = keyed.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"),
            F.count("bit").alias("cut"), F.sum("bit").alias("ones")).where(
            "n > 1 AND (cut < n OR ones BETWEEN 1 AND n - 1)")
        sums = written(sums, "keys")
        pairs.append(sums.where("n = 2").select("a", "b"))
        last = width == 16
        some = keyed.join(sums.where("n > 2" if last else f"n BETWEEN 3 AND {bucket}").select("key"), "key")
        one = some.select("key", F.col("fp").alias("a"), F.col("bit").alias("x"))
        two = some.select("key", F.col("fp").alias("b"), F.col("bit").alias("y"))
        pairs.append(one.join(two, "key").where("a < b AND (x IS NULL OR y IS NULL OR x <> y)").select("a", "b"))
        large = sums.where(f"n > {bucket}").select("key")
        if last or large.isEmpty():
            break
        rows = written(keyed.join(large, "key").select("fp", "key", "low"), "large")
        width //= 2
    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more)
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, bits)).distinct()


def clusters(docs: DataFrame, bits: int = BITS, bucket: int = BUCKET, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``."""
    prints = written(with_fingerprints(docs.select("doc_id", text), text, "fp").select("doc_id", "fp"), "prints")
    first = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "first")
    roots = components(written(links(first.select("fp"), bits, bucket), "links"), "a", "b")
    # only fingerprints with links meet a component; the rest name themselves
    linked = first.join(roots, first.fp == roots.node).select("fp", "first", "root")
    named = linked.groupBy("root").agg(F.min("first").alias("least"))
    of = linked.join(named, "root").select("fp", "least")
    names = written(first.join(of, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id")), "names")
    # fingerprints that hold more than a thousandth of the rows: fewer than a thousand, so they
    # can go to every task, and their rows need not meet in one
    rows = first.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(names.where(F.col("n") * HOT > rows).select("fp", "component_id"))
    seldom = names.where(F.col("n") * HOT <= rows).select("fp", "component_id")
    hot = prints.join(often, "fp")
    rest = prints.join(often.select("fp"), "fp", "left_anti").join(seldom, "fp")
    return hot.unionByName(rest).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return clusters(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the smallest doc_id (null
    last), then the smallest digest of the text; of equal rows any one."""
    fp, key = fresh("fp", docs.columns), fresh("key", docs.columns)
    # one column that names a row up to equal ones, so that one exchange serves join and choice
    named = docs.withColumn(key, F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                                                    F.coalesce("text", F.lit(""))), 256))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    best = written(with_fingerprints(named, "text", fp).groupBy(F.col(fp).alias("fp")).agg(
        F.min(order).alias("best")), "best")
    roots = components(written(links(best.select("fp"), bits, bucket), "links"), "a", "b")
    linked = best.join(roots, best.fp == roots.node, "left").select("best", F.coalesce("root", "fp").alias("root"))
    chosen = linked.groupBy("root").agg(F.min("best").alias("best")).select(
        F.col("best.key").alias(key))
    return named.join(chosen, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
