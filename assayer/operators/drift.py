"""Two-sample Kolmogorov-Smirnov drift between a current and a reference table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expr import bucket_sql, long_numbers, measured_columns, num, ordinals
from assayer.operators.findings import as_findings
from assayer.session import written

# fixed values
ALPHA, D_THRESHOLD, D_HIGH = 0.05, 0.10, 0.25
MIN_VALUES, MIN_REFERENCE_ROWS, CURVE_POINTS = 10, 10, 20
SERIES_TERMS = 100
METHODS = ("asymptotic", "exact")

#: Ranges into which a part is cut, and the distinct values that one task may put in order.
SPLIT, PART_VALUES = 4096, 100_000
#: Largest product of the two sample sizes for which an exact p-value is counted: some seconds in one task.
EXACT_CELLS = 1_000_000_000


def paired_counts(current: DataFrame, reference: DataFrame, columns: Sequence[str] | None = None,
                  rule: str = "none", extra_identifiers: Iterable[str] = ()) -> DataFrame:
    """(column, ordinal, value, c, r): each value counted on its side.  Rows with equal
    values may be added up or not: what reads them only sums."""
    if columns is None:
        shared = set(measured_columns(reference, rule, extra_identifiers))
        columns = [c for c in measured_columns(current, rule, extra_identifiers) if c in shared]
    pos = ordinals(current)
    cur = long_numbers(current, columns).select("column", "ordinal", "value",
                                                F.lit(1).alias("c"), F.lit(0).alias("r"))
    ref_pos = F.create_map(*[F.lit(x) for c in columns for x in (c, pos[c])])
    ref = long_numbers(reference, columns).select("column", ref_pos[F.col("column")].alias("ordinal"),
                                                  "value", F.lit(0).alias("c"), F.lit(1).alias("r"))
    return cur.unionByName(ref)


def _edges(totals: DataFrame, path: Sequence[str], sizes: DataFrame) -> DataFrame:
    """Totals of parts in order, with what lies before each part (c0, r0; those of the path's start
    added), the gap at its end, and a bound of the gap inside it."""
    order = Window.partitionBy("column", *path).orderBy("part")
    n, m = F.col("n_cur"), F.col("n_ref")
    c1, r1 = F.col("c0") + F.col("bc"), F.col("r0") + F.col("br")
    return (totals.withColumns({"c0": F.col("start_c") + F.sum("bc").over(order) - F.col("bc"),
                                "r0": F.col("start_r") + F.sum("br").over(order) - F.col("br")})
            .join(sizes.select("column", "n_cur", "n_ref"), "column")
            .withColumns({"gap": F.abs(c1 / n - r1 / m),
                          "bound": F.greatest(c1 / n - F.col("r0") / m, r1 / m - F.col("c0") / n)}))


def _kept(edges: DataFrame, best: DataFrame) -> DataFrame:
    """Parts of more than one value whose inside may hold a larger gap than the best so far."""
    return edges.join(best, "column").where("lo < hi AND bound > d").drop("d")


def ks_statistic(pairs: DataFrame, part_values: int = PART_VALUES) -> DataFrame:
    """pairs(column, ordinal, value, c, r) -> one row per column with D and both means.

    Only totals of value buckets are taken over all rows; they combine before the
    shuffle.  The gap at a bucket's end is exact, and the gap inside it is bounded by its
    totals, so most buckets are done.  What may still hold the largest gap is cut
    into equal ranges, again and again, until no part has more than
    ``part_values`` distinct values, and only these parts are put in order.  Exact;
    no task orders more than that, however narrow the range of a column is.
    """
    marked = pairs.withColumn("part", F.expr(bucket_sql("value")))
    totals = written(marked.groupBy("column", "part").agg(
        F.max("ordinal").alias("ordinal"), F.sum("c").alias("bc"), F.sum("r").alias("br"),
        F.sum(F.col("value") * F.col("c")).alias("sc"), F.sum(F.col("value") * F.col("r")).alias("sr"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.lit(0).cast("long").alias("start_c"),
        F.lit(0).cast("long").alias("start_r")), "ks")
    sizes = totals.groupBy("column").agg(
        F.max("ordinal").alias("ordinal"), F.sum("br").alias("n_ref"), F.sum("bc").alias("n_cur"),
        F.sum("sc").alias("s_cur"), F.sum("sr").alias("s_ref")).where(
            (F.col("n_cur") >= MIN_VALUES) & (F.col("n_ref") >= MIN_VALUES))
    edges = _edges(totals, [], sizes)
    best = written(edges.groupBy("column").agg(F.max("gap").alias("d")), "ks")
    kept = written(_kept(edges, best), "ks")
    rows = marked.join(kept.select("column", "part"), ["column", "part"]).groupBy(
        "column", F.col("part").alias("path"), "value").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    parts = kept.select("column", F.col("part").alias("path"), "lo", "hi", "c0", "r0")
    while not parts.isEmpty():
        rows = written(rows, "ks")
        cut = rows.join(parts, ["column", "path"]).withColumn("part", F.least(F.lit(SPLIT - 1), F.floor(
            (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SPLIT)).cast("long"))
        totals = cut.groupBy("column", "path", "part").agg(
            F.sum("c").alias("bc"), F.sum("r").alias("br"), F.min("value").alias("lo"), F.max("value").alias("hi"),
            F.count(F.lit(1)).alias("values"), F.first("c0").alias("start_c"), F.first("r0").alias("start_r"))
        edges = _edges(totals, ["path"], sizes)
        finer = best.unionByName(edges.groupBy("column").agg(F.max("gap").alias("d")))
        best = written(finer.groupBy("column").agg(F.max("d").alias("d")), "ks")
        kept = written(_kept(edges, best), "ks")
        largest = kept.agg(F.max("values")).first()[0] or 0
        named = F.xxhash64("path", "part")
        rows = cut.select("column", "path", "part", "value", "c", "r").join(
            kept.select("column", "path", "part"), ["column", "path", "part"]).select(
            "column", named.alias("path"), "value", "c", "r")
        parts = kept.select("column", named.alias("path"), "lo", "hi", "c0", "r0")
        if largest <= part_values:
            break
    if not parts.isEmpty():
        inside = Window.partitionBy("column", "path").orderBy("value")
        gap = F.abs((F.col("c0") + F.sum("c").over(inside)) / F.col("n_cur")
                    - (F.col("r0") + F.sum("r").over(inside)) / F.col("n_ref"))
        within = (rows.join(parts, ["column", "path"]).join(sizes.select("column", "n_cur", "n_ref"), "column")
                  .withColumn("gap", gap).groupBy("column").agg(F.max("gap").alias("d")))
        best = best.unionByName(within).groupBy("column").agg(F.max("d").alias("d"))
    return sizes.join(best, "column").select(
        "column", "ordinal", "n_ref", "n_cur", "d", (F.col("s_ref") / F.col("n_ref")).alias("ref_mean"),
        (F.col("s_cur") / F.col("n_cur")).alias("cur_mean"))


def asymptotic_p(d: Column, n: Column, m: Column) -> Column:
    """2 sum (-1)^(k-1) exp(-2 k^2 lambda^2); below lambda 0.2 the sum is 1 to 20 digits."""
    # the product of two counts can pass the range of a long
    lam = d * F.sqrt(n.cast("double") * m.cast("double") / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0)
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def path_share(d: float, n: int, m: int) -> float:
    """Share of the lattice paths from (0, 0) to (n, m) that reach the distance ``d`` somewhere.

    Paths that stay inside are carried along anti-diagonals i + j = t, all cells of one at once,
    and of each only the band in which |i m - j n| stays below the distance.
    """
    limit, width = round(d * n * m), n + m
    if limit <= 0:
        return 1.0
    inside = np.zeros(n + 2)  # inside[i + 1]: cell (i, t - i)
    inside[1] = 1.0
    low, high = 0, 0
    for t in range(1, width + 1):
        first = max(0, t - m, (t * n - limit) // width + 1)
        last = min(n, t, -((-t * n - limit) // width) - 1)
        if first > last:
            return 1.0
        i = np.arange(first, last + 1)
        new = (inside[first:last + 1] * i + inside[first + 1:last + 2] * (t - i)) / t
        inside[low + 1:high + 2] = 0.0
        inside[first + 1:last + 2] = new
        low, high = first, last
    return float(min(1.0, max(0.0, 1.0 - inside[n + 1])))


@F.pandas_udf(T.DoubleType())
def exact_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Exact two-sided probability, on one row per column.  Its work follows d * n * m, so it is for
    small samples: an error where n * m is above ``EXACT_CELLS``; ask for the asymptotic form there."""
    cells = max((int(a) * int(b) for a, b in zip(n, m)), default=0)
    if cells > EXACT_CELLS:
        raise ValueError(f"an exact p-value of {cells} cells; the bound is {EXACT_CELLS}, use method='asymptotic'")
    return pd.Series([path_share(float(x), int(a), int(b)) for x, a, b in zip(d, n, m)], dtype="float64")


def ks_test(pairs: DataFrame, method: str = "asymptotic") -> DataFrame:
    """ks_statistic plus p-value, decision and severity.

    ``method``: "asymptotic" takes the limit series, "exact" counts lattice paths; the
    caller chooses, ``p_method`` repeats the choice.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    stats = ks_statistic(pairs)
    p = exact_p("d", "n_cur", "n_ref") if method == "exact" else asymptotic_p(F.col("d"), F.col("n_cur"), F.col("n_ref"))
    stats = stats.withColumn("p", p).withColumn("p_method", F.lit(method))
    drift = (F.col("p") < ALPHA) & (F.col("d") >= D_THRESHOLD)
    return stats.withColumn("is_drift", drift).withColumn(
        "severity", F.when(drift, F.when(F.col("d") > D_HIGH, "HIGH").otherwise("MEDIUM")))


def ks_result(tested: DataFrame) -> DataFrame:
    return tested.select(
        "column", "n_ref", "n_cur", F.round("d", 4).alias("ks_statistic"),
        F.round("p", 6).alias("p_value"), "is_drift", "severity",
        F.round("ref_mean", 4).alias("ref_mean"), F.round("cur_mean", 4).alias("cur_mean"))


def drift_findings(current: DataFrame, reference: DataFrame, rule: str = "none",
                   extra_identifiers: Iterable[str] = ()) -> DataFrame:
    t = ks_test(paired_counts(current, reference, rule=rule,
                              extra_identifiers=extra_identifiers)).where("is_drift")
    message = F.concat(
        F.lit("Significant distribution drift detected in column '"), "column",
        F.lit("' (KS-stat: "), num(F.col("d"), 3), F.lit(", p-value: "), num(F.col("p"), 6),
        F.lit(")."))
    return as_findings(
        t, stage=8, ordinal=F.col("ordinal") + 1, finding_type=F.lit("DISTRIBUTION_DRIFT"),
        column=F.col("column"), severity=F.col("severity"), message=message,
        count=F.lit(None), pct=F.lit(None),
        evidence=["column", F.round("d", 4).alias("ks_statistic"), num(F.col("p"), 6).alias("p_value"),
                  F.lit(ALPHA).alias("alpha_threshold"), F.lit(D_THRESHOLD).alias("d_threshold"),
                  F.round("cur_mean", 4).alias("current_mean"),
                  F.round("ref_mean", 4).alias("reference_mean")])


def ecdf_curve(pairs: DataFrame) -> DataFrame:
    """Both distribution functions at 20 equally spaced points per column.

    Each distinct value is counted once, at the first point it does not exceed;
    running totals over the 21 slots give the curve.
    """
    last = CURVE_POINTS - 1
    whole = pairs.groupBy("column").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.sum("c").alias("n_cur"), F.sum("r").alias("n_ref"))
    step = (F.col("hi") - F.col("lo")) / last
    grid = F.transform(F.sequence(F.lit(0), F.lit(last)),
                       lambda i: F.when(i == last, F.col("hi")).otherwise(F.col("lo") + i * step))
    # broadcast bound: one row per column of the table
    grids = (whole.where((F.col("n_cur") >= MIN_VALUES) & (F.col("n_ref") >= MIN_VALUES))
             .withColumn("grid", grid))
    slot = F.size(F.filter("grid", lambda g: g < F.col("value")))
    counted = (pairs.join(F.broadcast(grids.select("column", "grid")), "column")
               .groupBy("column", slot.alias("point"))
               .agg(F.sum("c").alias("c"), F.sum("r").alias("r")))
    points = grids.select("column", "n_cur", "n_ref", F.posexplode("grid").alias("point", "x"))
    running = Window.partitionBy("column").orderBy("point")  # 20 rows per column
    f = F.sum(F.coalesce("c", F.lit(0))).over(running) / F.col("n_cur")
    g = F.sum(F.coalesce("r", F.lit(0))).over(running) / F.col("n_ref")
    return (points.join(counted, ["column", "point"], "left")
            .select("column", "point", "x", f.alias("f"), g.alias("g"))
            .select("column", "point", F.round("x", 2).alias("x"), F.round("f", 4).alias("current_cdf"),
                    F.round("g", 4).alias("baseline_cdf"),
                    F.round(F.abs(F.col("f") - F.col("g")), 4).alias("d_distance")))


def drift_status(tested: DataFrame, reference: DataFrame | None) -> DataFrame:
    """One row: NOT_EXECUTED, INSUFFICIENT_DATA, STABLE or DRIFT_DETECTED."""
    totals = tested.agg(F.count(F.lit(1)).alias("columns_tested"),
                        F.count_if("is_drift").alias("drift_detected_count"))
    if reference is None:
        rows = F.lit(0)
    else:
        # only whether ten rows exist matters, so the count stops there
        rows = reference.limit(MIN_REFERENCE_ROWS).agg(F.count(F.lit(1))).scalar()
    status = (F.when(F.col("_rows") < MIN_REFERENCE_ROWS, "NOT_EXECUTED")
              .when(F.col("columns_tested") == 0, "INSUFFICIENT_DATA")
              .when(F.col("drift_detected_count") > 0, "DRIFT_DETECTED").otherwise("STABLE"))
    return (totals.withColumn("_rows", rows)
            .select(status.alias("status"), "columns_tested", "drift_detected_count"))
