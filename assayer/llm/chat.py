"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions only.

A logger that writes a conversation again after every turn leaves prefixes of
longer conversations.  Every turn has a digest; the rolling hash of the first k
turns (two 64-bit lanes over position and digest) names a prefix.  Conversations
equal as a whole are one; an anti-join with the prefixes that are shorter than
their conversation leaves the maximal ones, and only those are rendered.

No group is gathered whole before it is small: positions and rolling hashes are
taken per block of turn numbers and carried over by the sums of the blocks, and a
conversation of more than ``part_turns`` turns is rendered in several parts.

Rows: a repeated row (same conversation, turn, role and text) is one turn.
Turns are ordered by number, null first, then by digest of role and text.  A
null role or text is rendered empty, and differs from an empty one.  A null
conv_id is a conversation of its own.  Of equal conversations the smallest
conv_id stays (null only if it is alone), with their number in ``copies``.
Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import written

PART_TURNS = 4096
BLOCK = 256
#: The markers of the ChatML layout.
BEGIN, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"


def turn_digest() -> Column:
    """Digest of role and text that tells null from empty."""
    return F.sha2(F.concat(F.coalesce(F.concat(F.lit("r"), F.col("role")), F.lit("n")), F.lit("\x1f"),
                           F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("n"))), 256)


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, d, pos, n, h1, h2): position, number of turns and rolling hash up to here."""
    rows = turns.select("conv_id", "turn", turn_digest().alias("d")).distinct().withColumn(
        "block", F.floor(F.col("turn") / BLOCK))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "d")
    placed = rows.withColumn("k", F.row_number().over(order))
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    over = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    until = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("size").over(until), F.lit(0)).alias("before"),
                           F.sum("size").over(whole).alias("n"))
    same = [F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")), F.col("x.block").eqNullSafe(F.col("y.block"))]
    at = placed.alias("x").join(blocks.alias("y"), same).select(
        "x.conv_id", "x.block", "x.turn", "x.d", (F.col("before") + F.col("k")).alias("pos"), "n")
    at = at.withColumns({"g1": F.xxhash64("pos", "d"), "g2": F.xxhash64("d", "pos", F.lit("second lane"))})
    sums = at.groupBy("conv_id", "block").agg(F.bit_xor("g1").alias("s1"), F.bit_xor("g2").alias("s2"))
    sums = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(s).over(until), F.lit(0)).alias(b)
                                             for s, b in (("s1", "b1"), ("s2", "b2"))])
    to_here = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = at.withColumns({"w1": F.bit_xor("g1").over(to_here), "w2": F.bit_xor("g2").over(to_here)})
    return rolled.alias("x").join(sums.alias("y"), same).select(
        "x.conv_id", "turn", "d", "pos", "n", F.col("w1").bitwiseXOR(F.col("b1")).alias("h1"),
        F.col("w2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(placed: DataFrame) -> DataFrame:
    """(conv_id, n, copies) of the conversations that are no prefix of a longer one."""
    whole = placed.where("pos = n").groupBy("n", "h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    prefixes = placed.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv_id", "n", "copies")


def render(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, copies, text) of the maximal conversations."""
    placed = written(positions(turns), "turns")
    kept = maximal(placed).select(F.col("conv_id").alias("kept_id"), F.col("n").alias("n_turns"), "copies")
    texts = turns.select("conv_id", "turn", "role", "text").withColumn("d", turn_digest())
    spoken = placed.alias("x").join(kept, F.col("x.conv_id").eqNullSafe(F.col("kept_id"))).join(
        texts.dropDuplicates(["conv_id", "turn", "d"]).alias("y"),
        F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & F.col("x.turn").eqNullSafe(F.col("y.turn"))
        & (F.col("x.d") == F.col("y.d")))
    piece = F.concat(F.lit(BEGIN), F.coalesce("role", F.lit("")), F.lit(BREAK), F.coalesce("text", F.lit("")), F.lit(END))
    return spoken.select(
        "x.conv_id", F.floor((F.col("pos") - 1) / part_turns).alias("part"), "n_turns", "copies",
        F.struct("pos", piece.alias("piece")).alias("p")).groupBy("conv_id", "part", "n_turns", "copies").agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list("p")), lambda p: p["piece"])).alias("text"))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text,
             sha256(coalesce('r' || role, 'n') || chr(31) || coalesce('t' || text, 'n')) AS d FROM conversations),
     c AS (SELECT conv_id, count(*) AS n, list(d ORDER BY turn NULLS FIRST, d) AS l FROM t GROUP BY conv_id),
     w AS (SELECT min(conv_id) AS conv_id, n, count(*) AS copies, array_to_string(l, ' ') AS s FROM c GROUP BY n, l),
     p AS (SELECT DISTINCT array_to_string(l[1:k], ' ') AS s FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
     m AS (SELECT conv_id, n, copies FROM w WHERE s NOT IN (SELECT s FROM p)),
     r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM t)
SELECT m.conv_id, (pos - 1) // {PART_TURNS} AS part, n AS n_turns, copies,
       string_agg('{BEGIN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM m JOIN r ON m.conv_id IS NOT DISTINCT FROM r.conv_id
GROUP BY m.conv_id, part, n, copies
"""
