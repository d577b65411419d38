"""The findings frame: its schema, union, deduplication, numbering and signature."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.expr import severity_rank

FINDING_SCHEMA = (
    "stage INT, ordinal INT, finding_type STRING, column_name STRING, severity STRING, "
    "message STRING, affected_count LONG, affected_pct DOUBLE, expected_type STRING, "
    "actual_type STRING, evidence STRING")
STAGES = {"missing": 1, "duplicates": 2, "removed": 3, "added": 4, "retyped": 5,
          "outliers": 6, "forest": 7, "drift": 8}


def as_findings(df: DataFrame, *, stage, ordinal: Column, finding_type: Column, column: Column,
                severity: Column, message: Column, count: Column, pct: Column,
                evidence: Sequence[str | Column], expected: Column | None = None,
                actual: Column | None = None) -> DataFrame:
    stage = stage if isinstance(stage, Column) else F.lit(stage)
    none = F.lit(None).cast("string")
    return df.select(
        stage.cast("int").alias("stage"), ordinal.cast("int").alias("ordinal"),
        finding_type.alias("finding_type"), column.cast("string").alias("column_name"),
        severity.alias("severity"), message.alias("message"),
        count.cast("long").alias("affected_count"), pct.cast("double").alias("affected_pct"),
        (none if expected is None else expected).alias("expected_type"),
        (none if actual is None else actual).alias("actual_type"),
        F.to_json(F.struct(*evidence), {"ignoreNullFields": "false"}).alias("evidence"))


def union_findings(parts: Sequence[DataFrame]) -> DataFrame:
    """All findings, the first one kept per (type, column)."""
    every = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy("finding_type", "column_name").orderBy("stage", "ordinal")
    # findings are few per column of the audited table, whatever its size
    return (every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))


def numbered(findings: DataFrame, prefix: str, name: str, width: int = 0) -> DataFrame:
    """Add ``name`` = prefix + running number in stage order."""
    order = Window.orderBy("stage", "ordinal", F.col("column_name").asc_nulls_first())
    n = F.row_number().over(order)
    text = F.lpad(n.cast("string"), width, "0") if width else n.cast("string")
    return findings.withColumn("position", n).withColumn(name, F.concat(F.lit(prefix), text))


def evidence_items(findings: DataFrame) -> DataFrame:
    return numbered(findings, "E", "evidence_id").select(
        "evidence_id", "position", "finding_type", "column_name", "severity", "message",
        "affected_count", "affected_pct", "expected_type", "actual_type", "evidence")


def evidence_status(findings: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return findings.agg(
        n.alias("evidence_count"),
        F.when(n > 0, "EVIDENCE_AVAILABLE").otherwise("NO_EVIDENCE").alias("status"))


def severity_distribution(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("finding_count"))


def highest_severity(findings: DataFrame) -> DataFrame:
    known = F.when(severity_rank(F.col("severity")) > 0, severity_rank(F.col("severity")))
    return findings.agg(
        F.coalesce(F.max_by("severity", known), F.lit("NONE")).alias("highest_severity"))


def audit_status(findings: DataFrame) -> DataFrame:
    """One row: status, finding_count, highest severity, computed after the union."""
    known = F.when(severity_rank(F.col("severity")) > 0, severity_rank(F.col("severity")))
    n = F.count(F.lit(1))
    return findings.agg(
        F.when(n > 0, "ANOMALY_DETECTED").otherwise("HEALTHY").alias("status"),
        n.alias("finding_count"),
        F.coalesce(F.max_by("severity", known), F.lit("NONE")).alias("highest_severity"))


def finding_types(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.array_join(F.array_sort(F.collect_set("finding_type")), ", ").alias("finding_types"))


def by_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(F.col("severity") == severity)


# fixed values: topic -> parts of the type name
TOPICS = {
    "duplicate": ("DUPLICATE",),
    "missing": ("MISSING",),
    "schema": ("SCHEMA", "COLUMN"),
    "drift": ("DRIFT",),
    "outlier": ("OUTLIER", "ISOLATION"),
}


def by_topic(findings: DataFrame, topic: str) -> DataFrame:
    return findings.where(topic_test(topic))


def topic_test(topic: str) -> Column:
    words = TOPICS[topic]
    return reduce(lambda a, b: a | b, [F.col("finding_type").contains(w) for w in words])


def inspection_summary(findings: DataFrame) -> DataFrame:
    s = audit_status(findings)
    return s.select(
        "status", "finding_count", "highest_severity",
        F.when(F.col("finding_count") == 0,
               "Inspection completed successfully. No data-quality or schema-drift findings "
               "were detected.")
        .when(F.col("highest_severity") != "NONE",
              F.format_string("Inspection detected %d finding(s). Highest severity: %s. "
                              "Overall status: %s.", "finding_count", "highest_severity", "status"))
        .otherwise(F.format_string("Inspection detected %d finding(s). Overall status: %s.",
                                   "finding_count", "status")).alias("summary"))


def alerts(findings: DataFrame, dataset: str, limit: int | None = None,
           unread_only: bool = False) -> DataFrame:
    """Newest first: later findings were raised later.  ``limit`` is a page size, none by default."""
    out = (findings.where(F.col("severity").isin("CRITICAL", "HIGH"))
           .withColumn("is_read", F.lit(False)))
    if unread_only:
        out = out.where(~F.col("is_read"))
    newest = [F.desc("stage"), F.desc("ordinal"), F.desc_nulls_last("column_name")]
    out = out.orderBy(*newest)
    return ((out if limit is None else out.limit(limit))
            .select("severity", F.lit(dataset).alias("dataset"), "finding_type",
                    F.format_string("[%s] %s in %s", "severity", "finding_type", F.lit(dataset))
                    .alias("title"), "message", "is_read"))
