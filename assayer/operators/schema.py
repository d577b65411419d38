"""Logical schemas: inference, comparison, resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.expr import (IDENTIFIER_RULES, boolean_sql, data_type, datetime_sql, float_sql,
                                    ident, integer_sql, literal, logical_type_of, missing_sql,
                                    normalized_type, ordinals, schema_identifier)
from assayer.operators.findings import as_findings

_CHUNK = 50
# in order of precedence
TEXT_TESTS = {"boolean": boolean_sql, "integer": integer_sql, "float": float_sql,
              "datetime": datetime_sql}


def infer_schema(df: DataFrame) -> DataFrame:
    """(column, ordinal, logical_type) over all meaningful values, in one scan.

    Precedence: identifier name -> string, boolean, integer, float, datetime, string.
    """
    pos = ordinals(df)
    parts = []
    for start in range(0, len(df.columns), _CHUNK):
        names = df.columns[start:start + _CHUNK]
        aggs, rows = [], []
        for c in names:
            i = pos[c]
            native = logical_type_of(data_type(df, c))
            present = f"not {missing_sql(df, c)}"
            aggs.append(F.expr(f"count_if({present}) as n{i}"))
            if schema_identifier(c):
                kind = "'string'"
            elif native is not None:
                kind = f"case when n{i} > 0 then '{native}' else 'string' end"
            else:
                kind = f"case when n{i} = 0 then 'string'"
                for label, test in TEXT_TESTS.items():
                    aggs.append(F.expr(f"count_if({present} and {test(ident(c))}) as {label}{i}"))
                    kind += f" when {label}{i} = n{i} then '{label}'"
                kind += " else 'string' end"
            rows.append(f"struct({literal(c)} as column, {i} as ordinal, {kind} as logical_type)")
        parts.append(df.agg(*aggs).select(F.expr(f"inline(array({', '.join(rows)}))")))
    return reduce(DataFrame.unionByName, parts)


def identifier_columns(schema: DataFrame, columns: list[str]) -> DataFrame:
    """Which identifier rule each column name meets; joined to the schema table."""
    flags = F.array(*[
        F.struct(F.lit(c).alias("column"),
                 *[F.lit(IDENTIFIER_RULES[r](c)).alias(f"{r}_rule")
                   for r in ("schema", "outlier", "forest", "recovery")])
        for c in columns
    ])
    table = schema.limit(1).select(F.inline(flags))  # one row per column name
    return schema.join(table, "column")


def ragged_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All columns in order of first appearance; absent ones become null."""
    return a.unionByName(b, allowMissingColumns=True)


def compare_schemas(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(column, finding_type, severity, expected_type, actual_type) per difference.

    Both sides have one row per column of a table.
    """
    e = expected.select("column", F.col("logical_type").alias("expected_type"))
    a = actual.select("column", F.col("logical_type").alias("actual_type"))
    kind = (F.when(F.col("actual_type").isNull(), "COLUMN_REMOVED")
            .when(F.col("expected_type").isNull(), "COLUMN_ADDED")
            .when(normalized_type(F.col("expected_type")) != normalized_type(F.col("actual_type")),
                  "COLUMN_TYPE_CHANGED"))
    severity = (F.when(F.col("finding_type") == "COLUMN_REMOVED", "CRITICAL")
                .when(F.col("finding_type") == "COLUMN_ADDED", "MEDIUM").otherwise("HIGH"))
    return (e.join(a, "column", "full_outer").withColumn("finding_type", kind)
            .where(F.col("finding_type").isNotNull())
            .select("column", "finding_type", severity.alias("severity"),
                    "expected_type", "actual_type"))


def schema_findings(expected: DataFrame, actual: DataFrame) -> DataFrame:
    d = compare_schemas(expected, actual)
    stage = (F.when(F.col("finding_type") == "COLUMN_REMOVED", 3)
             .when(F.col("finding_type") == "COLUMN_ADDED", 4).otherwise(5))
    message = (
        F.when(F.col("finding_type") == "COLUMN_REMOVED", F.format_string(
            "Expected column '%s' is missing from the actual schema.", "column"))
        .when(F.col("finding_type") == "COLUMN_ADDED", F.format_string(
            "New column '%s' was detected in the actual schema.", "column"))
        .otherwise(F.format_string("Data type of column '%s' changed from '%s' to '%s'.",
                                   "column", "expected_type", "actual_type")))
    alphabetical = Window.partitionBy("finding_type").orderBy("column")
    return as_findings(
        d, stage=stage, ordinal=F.row_number().over(alphabetical),
        finding_type=F.col("finding_type"), column=F.col("column"), severity=F.col("severity"),
        message=message, count=F.lit(None), pct=F.lit(None),
        evidence=["column", "expected_type", "actual_type"],
        expected=F.col("expected_type"), actual=F.col("actual_type"))


def schema_status(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: DRIFT_DETECTED or STABLE, with counts of columns and differences."""
    d = compare_schemas(expected, actual)
    counts = d.agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.count_if(F.col("finding_type") == "COLUMN_REMOVED").alias("removed_count"),
        F.count_if(F.col("finding_type") == "COLUMN_ADDED").alias("added_count"),
        F.count_if(F.col("finding_type") == "COLUMN_TYPE_CHANGED").alias("changed_count"))
    size = expected.agg(F.count(F.lit(1)).alias("n")).scalar()
    now = actual.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select(
        F.when(F.col("finding_count") > 0, "DRIFT_DETECTED").otherwise("STABLE").alias("status"),
        size.alias("expected_column_count"), now.alias("actual_column_count"),
        "added_count", "removed_count", "changed_count", "finding_count")


def expected_schema(inferred: DataFrame, baseline: DataFrame | None = None,
                    requested: DataFrame | None = None) -> DataFrame:
    """The schema to compare with: the requested one, else the stored one, else
    the inferred one.  A source counts as a whole, not column by column."""
    sources = [(i, s) for i, s in enumerate((requested, baseline, inferred)) if s is not None]
    every = reduce(DataFrame.unionByName, [
        s.select("column", "logical_type", F.lit(i).alias("source")) for i, s in sources])
    best = every.agg(F.min("source")).scalar()
    label = F.when(F.col("source") == 0, "request").when(F.col("source") == 1, "baseline") \
        .otherwise("inferred")
    return every.where(F.col("source") == best).select("column", "logical_type",
                                                       label.alias("source"))


def accept_columns(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected schema extended by the columns that are new in the actual one."""
    new = actual.join(expected.select("column"), "column", "left_anti")
    return expected.select("column", "logical_type").unionByName(new.select("column", "logical_type"))
