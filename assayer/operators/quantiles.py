"""Moments and exact quantiles (linear interpolation) of many columns at once.

The built-in exact percentile keeps every distinct value of a column in one
aggregation buffer, and the approximate one sends a sketch from every task to one
reducer; neither holds for a table of a million splits.  Here the work is:

1. one pass counts the values per bucket (about 0.5 % of a typical column each),
   combined on the map side and merged by many reducers; running totals over the
   buckets say which of them hold the wanted ranks;
2. one pass groups only the values of those buckets;
3. these values are cut into sub-ranges, the sub-range that holds the rank is
   found from its totals, and only that one is ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.expr import bucket_sql, ident, literal, long_numbers, numbers_of, ordinals

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
MOMENTS = {"n": "count({c})", "mean": "avg({c})", "std": "stddev_pop({c})",
           "skewness": "skewness({c})", "min": "min({c})", "max": "max({c})"}
_SUBRANGES = 1024
# Columns per aggregate.  Six keep the generated code small enough to be compiled;
# every chunk reads only its own columns, so the scan volume stays the same.
_MOMENT_CHUNK = 6


def column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, ordinal, n, mean, std, skewness, min, max), population forms."""
    pos, parts = ordinals(df), []
    for start in range(0, len(columns), _MOMENT_CHUNK):
        names = columns[start:start + _MOMENT_CHUNK]
        aggs = [F.expr(f"{agg.format(c=ident(c))} as {name}_{pos[c]}")
                for c in names for name, agg in MOMENTS.items()]
        rows = ", ".join(
            f"struct({literal(c)} as column, {pos[c]} as ordinal, "
            + ", ".join(f"{name}_{pos[c]} as {name}" for name in MOMENTS) + ")" for c in names)
        parts.append(numbers_of(df, names).agg(*aggs).select(F.expr(f"inline(array({rows}))")))
    return reduce(DataFrame.unionByName, parts)


def column_summary(df: DataFrame, columns: Sequence[str],
                   probs: Mapping[str, float] = QUARTILES) -> DataFrame:
    """Moments and quantiles side by side; one row per column that has a number."""
    return column_moments(df, columns).join(exact_quantiles(df, columns, probs), "column")


def exact_quantiles(df: DataFrame, columns: Sequence[str],
                    probs: Mapping[str, float] = QUARTILES) -> DataFrame:
    """(column, one double per entry of probs) for the named columns of df."""
    names, ps = list(probs), list(probs.values())
    values = long_numbers(df, columns).select("column", "value")
    running = Window.partitionBy("column").orderBy("bucket")  # one row per bucket
    buckets = (values.groupBy("column", F.expr(bucket_sql("value")).alias("bucket"))
               .agg(F.expr("count(1) as c"), F.expr("min(value) as lo"), F.expr("max(value) as hi"))
               .withColumn("start", F.sum("c").over(running) - F.col("c"))
               .withColumn("n", F.sum("c").over(Window.partitionBy("column"))))
    aims = []
    for i, p in enumerate(ps):
        pos = f"{p}D * (n - 1)"
        has_lo = f"floor({pos}) >= start and floor({pos}) < start + c"
        has_hi = f"ceil({pos}) >= start and ceil({pos}) < start + c"
        aims += [F.expr(f"max({pos}) as pos_{i}"),
                 F.expr(f"max(case when {has_lo} then lo end) as lo_{i}"),
                 F.expr(f"max(case when {has_hi} then hi end) as hi_{i}"),
                 F.expr(f"max(case when {has_lo} then start end) as start_{i}")]
    targets = buckets.groupBy("column").agg(*aims)

    # broadcast bound: one row per column of the table
    inside = " or ".join(f"value between lo_{i} and hi_{i}" for i in range(len(ps)))
    hist = (values.join(F.broadcast(targets), "column").where(inside)
            .groupBy("column", "value").agg(F.expr("count(1) as c")))

    # From here on only the values of the wanted buckets are left.
    each = ", ".join(f"struct({i} as i, pos_{i} as pos, lo_{i} as lo, hi_{i} as hi, start_{i} as base)"
                     for i in range(len(ps)))
    sub = f"""case when hi > lo then least(int(floor((v - lo) / (hi - lo) * {_SUBRANGES})),
                                           {_SUBRANGES - 1})
                   else 0 end"""
    held = (hist.join(F.broadcast(targets), "column")
            .select("column", F.col("value").alias("v"), "c", F.expr(f"inline(array({each}))"))
            .where("v between lo and hi")
            .select("column", "i", "pos", "base", "v", "c", F.expr(f"{sub} as sub")))

    # at most 1024 rows per (column, quantile)
    by_sub = Window.partitionBy("column", "i").orderBy("sub")
    totals = (held.groupBy("column", "i", "pos", "base", "sub").agg(F.sum("c").alias("c"))
              .withColumn("start", F.col("base") + F.sum("c").over(by_sub) - F.col("c")))
    wanted = totals.where(
        "(floor(pos) >= start and floor(pos) < start + c)"
        " or (ceil(pos) >= start and ceil(pos) < start + c)").select(
        "column", "i", "sub", "start")
    in_sub = Window.partitionBy("column", "i", "sub").orderBy("v")
    ranked = (held.join(F.broadcast(wanted), ["column", "i", "sub"])
              .withColumn("first", F.col("start") + F.sum("c").over(in_sub) - F.col("c")))
    picks = []
    for i in range(len(ps)):
        at = "case when i = {i} and {k}(pos) >= first and {k}(pos) < first + c then v end"
        picks += [F.expr(f"max({at.format(i=i, k=k)}) as {k}_{i}") for k in ("floor", "ceil")]
        picks.append(F.expr(f"max(case when i = {i} then pos - floor(pos) end) as part_{i}"))
    found = ranked.groupBy("column").agg(*picks)
    return found.select("column", *[
        F.expr(f"floor_{i} + (ceil_{i} - floor_{i}) * part_{i} as {name}")
        for i, name in enumerate(names)])
