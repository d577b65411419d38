"""Queries over the stored history of audits.

inspections(inspection_id, dataset_path, status, highest_severity, row_count,
            finding_count, created_at)
inspection_findings(inspection_id, finding_type, severity, message, created_order)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expr import severity_rank

# fixed values
PENALTY = {"CRITICAL": 20, "HIGH": 10, "MEDIUM": 3, "LOW": 1}
OPTIMAL, DEGRADED = 85, 60
RECENT_LIMIT = 20
FRIENDLY_NAMES = (
    (("order_item",), "Order Items"), (("order_payment",), "Order Payments"),
    (("order_review",), "Order Reviews"), (("orders",), "Orders Stream"),
    (("customer",), "Customers"), (("product",), "Products Catalog"),
    (("anomaly", "test"), "Synthetic Benchmark"),
)


def friendly_name(path: Column) -> Column:
    """Readable name of a dataset path; the first matching part decides."""
    p, base = F.lower(path), F.substring_index(path, "/", -1)
    out = None
    for words, name in FRIENDLY_NAMES:
        cond = F.lit(False)
        for w in words:
            cond = cond | p.contains(w)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return (out.when(p.contains("upload"), F.concat(F.lit("Upload: "), base))
            .otherwise(F.when(base == "", path).otherwise(base)))


def friendly_names(paths: DataFrame, column: str) -> DataFrame:
    return paths.withColumn("friendly_name", friendly_name(F.col(column)))


def inspections_from_runs(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """One inspection per run, with the worst severity of its findings."""
    known = F.when(severity_rank(F.col("severity")) > 0, severity_rank(F.col("severity")))
    worst = findings.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("finding_count"), F.max_by("severity", known).alias("worst"))
    n = F.coalesce("finding_count", F.lit(0))
    return (runs.join(worst, "run_id", "left").select(
        F.col("run_id").alias("inspection_id"),
        F.concat(F.lit("events/"), "pipeline_id").alias("dataset_path"),
        F.when(n > 0, "ANOMALY_DETECTED").otherwise("HEALTHY").alias("status"),
        F.coalesce("worst", F.lit("NONE")).alias("highest_severity"),
        F.col("rows_input").alias("row_count"), n.alias("finding_count"),
        F.col("started_at").alias("created_at")))


def recent_audits(inspections: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """A page of audits, newest first (top-n without a full sort)."""
    return (inspections.orderBy(F.desc("created_at"), "inspection_id").limit(limit)
            .withColumn("friendly_name", friendly_name(F.col("dataset_path"))))


def latest_audit(inspections: DataFrame) -> DataFrame:
    return inspections.orderBy(F.desc("created_at"), "inspection_id").limit(1)


def health_index(inspections: DataFrame, findings: DataFrame) -> DataFrame:
    """100 minus penalties of the latest audit's findings; 100 when there is none."""
    latest = latest_audit(inspections).select("inspection_id").scalar()
    return _health(findings.where(F.col("inspection_id") == latest))


def health_by_audit(inspections: DataFrame, findings: DataFrame) -> DataFrame:
    """(inspection_id, health_index, health_status) of every audit, those without findings too."""
    rows = inspections.select("inspection_id").join(findings, "inspection_id", "left")
    return _health(rows, "inspection_id")


def _health(findings: DataFrame, *by: str) -> DataFrame:
    penalty = F.lit(0)
    for name, weight in PENALTY.items():
        penalty = penalty + F.count_if(F.col("severity") == name) * weight
    index = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("penalty")))
    return (findings.groupBy(*by).agg(penalty.alias("penalty"))
            .select(*by, index.cast("long").alias("health_index"))
            .withColumn("health_status", F.when(F.col("health_index") >= OPTIMAL, "OPTIMAL")
                        .when(F.col("health_index") >= DEGRADED, "DEGRADED")
                        .otherwise("CRITICAL_ATTENTION")))


def dashboard_totals(inspections: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return findings.agg(
        n.alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"{s.lower()}_findings") for s in PENALTY]
    ).withColumn("total_inspections", inspections.agg(n).scalar()).withColumn(
        "total_etl_runs", runs.agg(n).scalar())


def audit_dossier(inspections: DataFrame, findings: DataFrame, inspection_id: Column | None = None) -> DataFrame:
    """One audit with its findings in creation order; the latest audit by default.  A healthy
    audit is one row without a finding."""
    if inspection_id is None:
        inspection_id = latest_audit(inspections).select("inspection_id").scalar()
    run = inspections.where(F.col("inspection_id") == inspection_id)
    return (run.join(findings.select("inspection_id", "created_order", "finding_type", "severity", "message"),
                     "inspection_id", "left")
            .select("inspection_id", "dataset_path", "status", "highest_severity", "row_count",
                    F.col("created_order").alias("position"), "finding_type", "severity", "message")
            .orderBy("position"))

