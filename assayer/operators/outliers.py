"""Z-score and IQR outliers of single columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.expr import ident, literal, long_numbers, measured_columns, num, numbers_of, row_id
from assayer.operators.findings import as_findings
from assayer.operators.quantiles import column_summary
from assayer.session import written

# fixed values
Z_THRESHOLD, IQR_MULTIPLIER = 3.0, 1.5
MIN_VALUES, FLAT = 5, 1e-8
SKEW_LIMIT, SKEWED_PCT, SKEWED_MAX_Z = 1.5, 15.0, 15.0
PLAIN_PCT, PLAIN_COUNT = 5.0, 3
HIGH_PCT, HIGH_MAX_Z, MEDIUM_PCT = 15.0, 6.0, 7.0
EVIDENCE_ROWS, CHART_ROWS = 5, 40

# Columns per counting scan, so that the generated code stays within what is compiled.
_COUNT_CHUNK = 24


def outlier_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics of the columns that can be tested: at least 5 numbers, not
    constant, and a spread between the quartiles."""
    return (column_summary(df, columns)
            .where((F.col("n") >= MIN_VALUES) & (F.col("std") >= FLAT) & (F.col("min") != F.col("max")))
            .withColumn("iqr", F.col("q75") - F.col("q25")).where(F.col("iqr") >= FLAT)
            .withColumn("lower_fence", F.col("q25") - IQR_MULTIPLIER * F.col("iqr"))
            .withColumn("upper_fence", F.col("q75") + IQR_MULTIPLIER * F.col("iqr"))
            .withColumn("max_z", F.expr("greatest(max - mean, mean - min) / std")))


def tested_columns(df: DataFrame, columns: Sequence[str] | None = None,
                   extra_identifiers: Iterable[str] = ()) -> list[str]:
    return list(columns) if columns else measured_columns(df, "outlier", extra_identifiers)


def _z() -> Column:
    return F.abs((F.col("value") - F.col("mean")) / F.col("std"))


def _outside() -> Column:
    return (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))


def _tested(values: DataFrame, stats: DataFrame) -> DataFrame:
    """Values beside their column's statistics; broadcast bound: columns of the table."""
    return values.join(F.broadcast(stats.drop("ordinal", "n")), "column")


def zscore_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Every value more than 3 population deviations from its column's mean."""
    columns = tested_columns(df, columns)
    values = long_numbers(df, columns, [row_id(keys).alias("_rid")])
    return (_tested(values, outlier_stats(df, columns)).where(_z() > Z_THRESHOLD)
            .select("_rid", "column", "value", F.round("mean", 4).alias("mean"),
                    F.round("std", 4).alias("std_dev"), F.round(_z(), 2).alias("z_score"),
                    F.lit(Z_THRESHOLD).alias("threshold")))


def iqr_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Every value outside its column's fences, with the direction."""
    columns = tested_columns(df, columns)
    values = long_numbers(df, columns, [row_id(keys).alias("_rid")])
    return (_tested(values, outlier_stats(df, columns)).where(_outside())
            .select("_rid", "column", "value",
                    F.when(F.col("value") < F.col("lower_fence"), "LOW").otherwise("HIGH")
                    .alias("direction"),
                    F.round("q25", 4).alias("q1"), F.round("q75", 4).alias("q3"),
                    F.round("iqr", 4).alias("iqr"), F.round("lower_fence", 4).alias("lower_bound"),
                    F.round("upper_fence", 4).alias("upper_bound")))


def outlier_measures(df: DataFrame, columns: Sequence[str] | None = None,
                     extra_identifiers: Iterable[str] = ()) -> DataFrame:
    """Unrounded summary per testable column; the counting pass runs without a row shuffle."""
    columns = tested_columns(df, columns, extra_identifiers)
    stats = written(outlier_stats(df, columns), "outliers")
    # a row per column of the table: its numbers become part of the one scan that counts
    known = stats.select("column", "mean", "std", "lower_fence", "upper_fence").orderBy("ordinal").collect()
    counted = None
    for start in range(0, len(known), _COUNT_CHUNK):
        some = known[start:start + _COUNT_CHUNK]
        counts, rows = [], []
        for i, r in enumerate(some):
            x, mean, std, low, high = ident(r["column"]), *(f"double('{v!r}')" for v in r[1:])
            counts += [F.expr(f"count_if(abs(({x} - {mean}) / {std}) > {Z_THRESHOLD}D) as z{i}"),
                       F.expr(f"count_if({x} < {low} or {x} > {high}) as q{i}")]
            rows.append(f"struct({literal(r['column'])} as column, z{i} as z_outlier_count, q{i} as iqr_outlier_count)")
        part = numbers_of(df, [r["column"] for r in some]).agg(*counts).select(F.expr(f"inline(array({', '.join(rows)}))"))
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        none = F.lit(0).cast("long")
        counted = stats.select("column", none.alias("z_outlier_count"), none.alias("iqr_outlier_count"))
    return (stats.join(counted, "column")
            .withColumn("outlier_percentage",
                        F.round(F.col("iqr_outlier_count") / F.col("n") * 100, 2))
            .withColumn("is_skewed", F.abs("skewness") > SKEW_LIMIT))


def outlier_summary(df: DataFrame, extra_identifiers: Iterable[str] = ()) -> DataFrame:
    return outlier_measures(df, extra_identifiers=extra_identifiers).select(
        "column", F.col("n").alias("valid_count"), F.round("mean", 4).alias("mean"),
        F.round("std", 4).alias("std"), F.round("skewness", 4).alias("skewness"), "is_skewed",
        "z_outlier_count", "iqr_outlier_count", "outlier_percentage",
        F.round("lower_fence", 4).alias("lower_fence"),
        F.round("upper_fence", 4).alias("upper_fence"), F.round("max_z", 2).alias("max_z_score"))


def is_finding() -> Column:
    skewed = (F.col("outlier_percentage") >= SKEWED_PCT) | (F.col("max_z") > SKEWED_MAX_Z)
    plain = (F.col("outlier_percentage") >= PLAIN_PCT) & (F.col("iqr_outlier_count") >= PLAIN_COUNT)
    return F.when(F.col("is_skewed"), skewed).otherwise(plain)


def finding_severity() -> Column:
    return (F.when((F.col("outlier_percentage") > HIGH_PCT) | (F.col("max_z") > HIGH_MAX_Z), "HIGH")
            .when(F.col("outlier_percentage") > MEDIUM_PCT, "MEDIUM").otherwise("LOW"))


def outlier_findings(df: DataFrame, extra_identifiers: Iterable[str] = ()) -> DataFrame:
    m = outlier_measures(df, extra_identifiers=extra_identifiers).where(is_finding())
    message = F.concat(
        F.lit("Column '"), "column", F.lit("' contains "), F.col("iqr_outlier_count").cast("string"),
        F.lit(" outlier value(s) ("), F.col("outlier_percentage").cast("string"),
        F.lit("%) outside fences ["), num(F.col("lower_fence"), 2), F.lit(", "),
        num(F.col("upper_fence"), 2), F.lit("] (max Z: "), num(F.col("max_z"), 1), F.lit(")."))
    return as_findings(
        m, stage=6, ordinal=F.col("ordinal") + 1, finding_type=F.lit("NUMERICAL_OUTLIERS"),
        column=F.col("column"), severity=finding_severity(), message=message,
        count=F.col("iqr_outlier_count"), pct=F.col("outlier_percentage"),
        evidence=["column", F.col("iqr_outlier_count").alias("outlier_count"),
                  "outlier_percentage", F.col("n").alias("total_valid"),
                  F.round("lower_fence", 4).alias("lower_fence"),
                  F.round("upper_fence", 4).alias("upper_fence"),
                  F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                  F.round("skewness", 4).alias("skewness"),
                  F.round("max_z", 2).alias("max_z_score")])


def outlier_samples(df: DataFrame, keys: Sequence[str], k: int = EVIDENCE_ROWS,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """The first k IQR outliers of each column in key order.

    The rank filter is pushed below the shuffle (window group limit), so at most
    k rows per task and column travel.
    """
    columns = tested_columns(df, columns)
    values = long_numbers(df, columns, [row_id(keys).alias("_rid"), F.struct(*keys).alias("_key")])
    order = Window.partitionBy("column").orderBy("_key")
    return (_tested(values, outlier_stats(df, columns)).where(_outside())
            .withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
            .select("column", "position", "_rid", "value"))


def chart_points(df: DataFrame, keys: Sequence[str], k: int = CHART_ROWS,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """The first k values of each testable column in key order, with their z-score."""
    columns = tested_columns(df, columns)
    values = long_numbers(df, columns, [row_id(keys).alias("_rid"), F.struct(*keys).alias("_key")])
    order = Window.partitionBy("column").orderBy("_key")
    first = (values.withColumn("position", F.row_number().over(order))
             .where(F.col("position") <= k))
    return (_tested(first, outlier_stats(df, columns))
            .select("column", "position", "_rid", F.round("value", 2).alias("value"),
                    F.round(_z(), 2).alias("z_score")))


def boxplot_summary(df: DataFrame, extra_identifiers: Iterable[str] = ()) -> DataFrame:
    m = outlier_measures(df, extra_identifiers=extra_identifiers)
    return m.select(
        "column", F.col("n").alias("sample_size"),
        *[F.round(c, 4).alias(t) for c, t in (
            ("min", "min"), ("lower_fence", "lower_bound"), ("q25", "q1"), ("median", "median"),
            ("q75", "q3"), ("upper_fence", "upper_bound"), ("max", "max"), ("iqr", "iqr"))],
        F.col("iqr_outlier_count").alias("outlier_count"), "outlier_percentage",
        F.when(F.col("iqr_outlier_count") > 0, "OUTLIER_DETECTED").otherwise("HEALTHY")
        .alias("iqr_status"),
        F.col("z_outlier_count").alias("flagged_count"), F.round("max_z", 2).alias("max_z_score"),
        F.when(F.col("z_outlier_count") > 0, "ANOMALY_DETECTED").otherwise("HEALTHY")
        .alias("z_status"))


def method_proofs(measures: DataFrame) -> DataFrame:
    """One row per method over all columns; NOT_APPLICABLE when none could be tested."""
    n = F.count(F.lit(1))
    totals = measures.agg(
        n.alias("columns_analyzed"),
        F.coalesce(F.sum("z_outlier_count"), F.lit(0)).alias("z"),
        F.coalesce(F.sum("iqr_outlier_count"), F.lit(0)).alias("iqr"),
        F.coalesce(F.max(F.round("max_z", 2)), F.lit(0.0)).alias("max_z"))
    ran = F.col("columns_analyzed") > 0
    execution = F.when(ran, "EXECUTED").otherwise("NOT_APPLICABLE")

    def status(count, label):
        return (F.when(~ran, "NOT_APPLICABLE").when(count > 0, label).otherwise("HEALTHY"))

    return totals.select("columns_analyzed", F.inline(F.array(
        F.struct(F.lit("Z-Score").alias("method"), execution.alias("execution_status"),
                 status(F.col("z"), "ANOMALY_DETECTED").alias("status"),
                 F.col("z").alias("total_flagged_count"), F.col("max_z").alias("max_z_score")),
        F.struct(F.lit("IQR").alias("method"), execution.alias("execution_status"),
                 status(F.col("iqr"), "OUTLIER_DETECTED").alias("status"),
                 F.col("iqr").alias("total_flagged_count"),
                 F.lit(None).cast("double").alias("max_z_score")))))
