"""Missing cells, duplicate rows, empty data and the quality score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.expr import (as_text, ident, is_nested, ladder, literal, missing, missing_sql,
                                    ordinals, quoted, stripped)
from assayer.operators.findings import as_findings

# fixed values: lower bounds in percent
MISSING_STEPS = ((50, "CRITICAL"), (10, "HIGH"), (5, "MEDIUM"))
DUPLICATE_STEPS = ((20, "CRITICAL"), (10, "HIGH"), (5, "MEDIUM"))
COMPLETENESS_WEIGHT, UNIQUENESS_WEIGHT = 0.6, 0.4

_CHUNK = 100  # columns per aggregate, keeps generated code within limits


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a single missing cell."""
    return df.where(~reduce(or_, [missing(df, c) for c in df.columns]))


def missing_counts(df: DataFrame, order_key: str | None = None) -> DataFrame:
    """(column, ordinal, missing_count, total_rows, first_key): one scan, no shuffle of rows."""
    pos = ordinals(df)
    parts = []
    for start in range(0, len(df.columns), _CHUNK):
        names = df.columns[start:start + _CHUNK]
        aggs, rows = [F.expr("count(1) as total")], []
        for c in names:
            i, miss = pos[c], missing_sql(df, c)
            first = f"min(if({miss}, {ident(order_key)}, null))" if order_key else "bigint(null)"
            aggs += [F.expr(f"count_if({miss}) as m{i}"), F.expr(f"{first} as f{i}")]
            rows.append(f"struct({literal(c)} as column, {i} as ordinal, m{i} as missing_count, "
                        f"total as total_rows, f{i} as first_key)")
        parts.append(df.agg(*aggs).select(F.expr(f"inline(array({', '.join(rows)}))")))
    return reduce(DataFrame.unionByName, parts)


def missing_values(df: DataFrame, order_key: str | None = None) -> DataFrame:
    """One row per column with missing cells, in order of the first affected row."""
    return missing_of(missing_counts(df, order_key))


def missing_of(counts: DataFrame) -> DataFrame:
    """``missing_values`` of the counts of a table, or of those of several tables added up."""
    pct = F.col("missing_count") / F.col("total_rows") * 100
    # one row per column of the table, so the window stays tiny
    first = Window.orderBy(F.col("first_key").asc_nulls_first(), "ordinal")
    return (counts.where(F.col("missing_count") > 0)
            .select("column", "missing_count", "total_rows",
                    F.round(pct, 2).alias("missing_percentage"),
                    ladder(pct, MISSING_STEPS, "LOW").alias("severity"),
                    F.row_number().over(first).alias("position")))


def missing_findings(df: DataFrame, order_key: str | None = None) -> DataFrame:
    return missing_findings_of(missing_counts(df, order_key))


def missing_findings_of(counts: DataFrame) -> DataFrame:
    return as_findings(
        missing_of(counts), stage=1, ordinal=F.col("position"), finding_type=F.lit("MISSING_VALUES"),
        column=F.col("column"), severity=F.col("severity"),
        message=F.format_string("Column '%s' contains %d missing value(s).", "column", "missing_count"),
        count=F.col("missing_count"), pct=F.col("missing_percentage"),
        evidence=["column", "missing_count", "missing_percentage", "total_rows"])


def group_keys(df: DataFrame, normalise: str = "string") -> list[Column]:
    """What makes two rows equal.

    exact    the values themselves
    string   their text, null reading as "None"
    trimmed  their trimmed text, null reading as blank
    """
    if normalise == "exact":
        return [as_text(df, c) if is_nested(df.schema[c].dataType) else quoted(c)
                for c in df.columns]
    if normalise == "string":
        return [F.coalesce(as_text(df, c), F.lit("None")) for c in df.columns]
    if normalise == "trimmed":
        return [F.coalesce(stripped(as_text(df, c)), F.lit("")) for c in df.columns]
    raise ValueError(f"unknown normalise: {normalise}")


def row_digest(df: DataFrame, normalise: str = "string") -> Column:
    """256-bit digest of what makes rows equal.  Each text is led by its length, a null has
    none, so different rows have different texts."""
    texts = []
    for k in group_keys(df, normalise):
        t = k.cast("string")
        texts.append(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")))
    return F.sha2(F.concat(*texts) if texts else F.lit(""), 256)


def duplicate_counts(df: DataFrame, normalise: str = "string") -> DataFrame:
    """One row (total_rows, duplicate_count); digests travel, and copies combine before the shuffle."""
    return duplicate_totals(df.groupBy(row_digest(df, normalise).alias("digest")).agg(F.count(F.lit(1)).alias("copies")))


def duplicate_totals(copies: DataFrame) -> DataFrame:
    """(total_rows, duplicate_count) of rows with a column ``copies``, one row a digest."""
    return (copies
            .agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
                 F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count")))


def duplicate_records(df: DataFrame, normalise: str = "string") -> DataFrame:
    return duplicates_of(duplicate_counts(df, normalise))


def duplicates_of(totals: DataFrame) -> DataFrame:
    pct = F.col("duplicate_count") / F.col("total_rows") * 100
    return (totals.where(F.col("duplicate_count") > 0)
            .select("duplicate_count", "total_rows",
                    F.round(pct, 2).alias("duplicate_percentage"),
                    ladder(pct, DUPLICATE_STEPS, "LOW").alias("severity")))


def duplicate_findings(df: DataFrame, normalise: str = "string") -> DataFrame:
    return duplicate_findings_of(duplicate_counts(df, normalise))


def duplicate_findings_of(totals: DataFrame) -> DataFrame:
    return as_findings(
        duplicates_of(totals), stage=2, ordinal=F.lit(1),
        finding_type=F.lit("DUPLICATE_RECORDS"), column=F.lit(None), severity=F.col("severity"),
        message=F.format_string("Detected %d duplicate record(s).", "duplicate_count"),
        count=F.col("duplicate_count"), pct=F.col("duplicate_percentage"),
        evidence=["duplicate_count", "duplicate_percentage", "total_rows"])


def empty_findings(df: DataFrame) -> DataFrame:
    """A finding when there is no row at all; ``limit(1)`` stops at the first one."""
    n = df.limit(1).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") == 0)
    return as_findings(
        n, stage=0, ordinal=F.lit(1), finding_type=F.lit("EMPTY_DATASET"), column=F.lit(None),
        severity=F.lit("CRITICAL"), message=F.lit("The dataset contains no records."),
        count=F.col("row_count"), pct=F.lit(None), evidence=["row_count"])


def empty_columns(df: DataFrame) -> DataFrame:
    return (missing_counts(df).where((F.col("missing_count") == F.col("total_rows"))
                                     & (F.col("total_rows") > 0))
            .select("column", "total_rows"))


def quality_score(df: DataFrame, normalise: str = "exact") -> DataFrame:
    """One row: totals, score = 0.6 completeness + 0.4 uniqueness (percent), validity."""
    width = len(df.columns)
    cells = missing_counts(df).agg(
        F.sum("missing_count").alias("missing_values"),
        F.count_if((F.col("missing_count") == F.col("total_rows"))
                   & (F.col("total_rows") > 0)).alias("empty_column_count"))
    # both sides are one-row aggregates: the second is read as a scalar subquery
    both = duplicate_counts(df, normalise).select(
        "total_rows", F.col("duplicate_count").alias("duplicate_rows"),
        cells.select(F.struct("missing_values", "empty_column_count")).scalar().alias("c"))
    n = F.col("total_rows")
    complete = 1 - F.coalesce(F.try_divide(F.col("c.missing_values"), n * width), F.lit(0.0))
    unique = 1 - F.coalesce(F.try_divide(F.col("duplicate_rows"), n), F.lit(0.0))
    score = 100 * (COMPLETENESS_WEIGHT * complete + UNIQUENESS_WEIGHT * unique)
    return both.select(
        "total_rows", F.lit(width).cast("long").alias("total_columns"),
        F.col("c.missing_values").alias("missing_values"), "duplicate_rows",
        F.col("c.empty_column_count").alias("empty_column_count"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2).alias("quality_score"),
        ((F.col("c.missing_values") == 0) & (F.col("duplicate_rows") == 0)
         & (F.col("c.empty_column_count") == 0)).alias("is_valid"))


def tiny(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
