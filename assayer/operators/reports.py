"""Report tables; rendering them is left to the reader's tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expr import num, quoted
from assayer.operators.findings import numbered
from assayer.operators.proofs import FOREST, KS

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def report_summary(status: DataFrame, dataset_path: str, row_count: DataFrame, column_count: int,
                   audit_hash: DataFrame | None = None, audit_hmac: DataFrame | None = None) -> DataFrame:
    """(position, metric, value) of one audit."""
    digest = audit_hash.select("audit_hash").scalar() if audit_hash is not None else F.lit(None)
    keyed = audit_hmac.select("audit_hmac").scalar() if audit_hmac is not None else F.lit(None)
    one = (status.withColumn("_rows", row_count.agg(F.count(F.lit(1))).scalar())
           .withColumn("_hash", F.coalesce(digest, F.lit("UNVERIFIED")))
           .withColumn("_hmac", F.coalesce(keyed, F.lit("UNVERIFIED"))))
    entries = [("Dataset Path", F.lit(dataset_path)), ("Audit Status", F.col("status")),
               ("Row Count", F.col("_rows")), ("Column Count", F.lit(column_count)),
               ("Finding Count", F.col("finding_count")), ("Audit SHA-256 Hash", F.col("_hash")),
               ("HMAC Signature", F.col("_hmac"))]
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"),
                 v.cast("string").alias("value")) for i, (m, v) in enumerate(entries, 1)])))


def findings_log(findings: DataFrame) -> DataFrame:
    """(position, finding_type, severity, message, evidence) in finding order."""
    return numbered(findings, "E", "evidence_id").select("position", "finding_type", "severity", "message", "evidence")


# fixed values: agent and classification by method
METHODS = {
    "Z-Score": ("Inspector Agent", "Statistical anomaly detection"),
    "IQR": ("Inspector Agent", "Statistical outlier detection"),
    FOREST: ("Inspector Agent", "Unsupervised ML anomaly detection"),
    KS: ("Drift Agent", "Statistical distribution drift detection"),
}


def method_sheet(proofs: DataFrame) -> DataFrame:
    """(method, agent, classification, execution_status, evidence) per detection method."""
    method = F.col("method")
    text = F.when(method == "Z-Score", F.format_string(
        "Columns analyzed: %d, Flagged count: %d, Max |Z|: %s, Threshold: |z| > 3.0",
        "columns_analyzed", "total_flagged_count", num(F.col("max_z_score"), 2)))
    text = text.when(method == "IQR", F.format_string(
        "Columns analyzed: %d, Outliers count: %d, Method rule: 1.5 × IQR", "columns_analyzed", "total_flagged_count"))
    text = text.when(method == FOREST, F.format_string(
        "Samples: %d, Features: %d, Anomalies: %d, Contamination: auto", F.coalesce("samples", F.lit(0)),
        "columns_analyzed", "total_flagged_count"))
    text = text.when(F.col("execution_status") == "NOT_EXECUTED", "NOT EXECUTED: historical baseline unavailable")
    text = text.otherwise(F.format_string("Columns tested: %d, Drift count: %d, Rule: p < 0.05 AND D >= 0.10",
                                          "columns_analyzed", "total_flagged_count"))

    def fixed(i):
        out = F.lit(None).cast("string")
        for name, values in METHODS.items():
            out = F.when(method == name, values[i]).otherwise(out)
        return out

    return proofs.select("method", fixed(0).alias("agent"), fixed(1).alias("classification"), "execution_status",
                         text.alias("evidence"))


def report_actions(gated: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """Executed and skipped actions in one table with the rows they touched."""
    rows = gated
    if audit is not None:
        rows = rows.join(F.broadcast(audit.select("action_type", "target", "rows_affected")),
                         ["action_type", "target"], "left")
    else:
        rows = rows.withColumn("rows_affected", F.lit(None).cast("long"))
    skipped = F.col("execution_status") == "SKIPPED_POLICY_RESTRICTION"
    return rows.select(
        "action_id", "action_type", "target", "severity", "risk_level", "policy_status",
        F.when(skipped, 0).otherwise(F.coalesce("rows_affected", F.lit(0))).alias("rows_affected"),
        F.when(skipped, F.concat(F.lit("SKIPPED ("), "reason", F.lit(")")))
        .otherwise("EXECUTED").alias("status"))


def recovery_log_table(verdict: DataFrame, dataset_path: str, role: str) -> DataFrame:
    """(position, metric, value) of one repair."""
    entries = [("Target Dataset", F.lit(dataset_path)), ("Execution Status", F.lit("RECOVERY_APPLIED")),
               ("Verification Verdict", F.col("verdict")),
               ("Original Input Rows", F.col("original_row_count")),
               ("Remediated Output Rows", F.col("remediated_row_count")),
               ("Row Count Delta", F.col("row_delta")), ("Executed By Role", F.lit(role))]
    return verdict.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"),
                 v.cast("string").alias("value")) for i, (m, v) in enumerate(entries, 1)])))


def export_iso_dates(df: DataFrame) -> DataFrame:
    """A ``<name>_date`` column beside each text column: the date where the text is
    an ISO date, null elsewhere."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            c = quoted(f.name)
            out = out.withColumn(f"{f.name}_date", F.when(
                c.rlike(ISO_DATE), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")))
    return out
