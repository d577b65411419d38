"""From findings to root causes and recommendations.

All inputs here are findings of one audit: a few rows per column of the audited
table, whatever the number of its rows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.expr import num
from assayer.operators.findings import evidence_items, numbered

# fixed values: finding type -> (confidence, cause, affected area)
CAUSES = {
    "MISSING_VALUES": (
        0.75, "Potential incomplete source data or missing records during data ingestion.",
        "Source data or data ingestion"),
    "DUPLICATE_RECORDS": (
        0.80, "Potential duplicate data introduced during extraction, transformation, or loading.",
        "Extraction, transformation, or loading"),
    "COLUMN_REMOVED": (
        0.90, "Potential upstream schema change or ETL transformation removing an expected column.",
        "Source schema or transformation"),
    "COLUMN_ADDED": (
        0.70, "Potential upstream schema expansion or source-system change.", "Source schema"),
    "COLUMN_TYPE_CHANGED": (
        0.85, "Potential upstream schema type change or transformation type conversion.",
        "Source schema or transformation"),
}
OTHER_CAUSE = (0.50, "ETL pipeline")
# fixed values: patterns over several findings, in order of insertion at the front
PATTERNS = {
    "contract": (0.95, "Upstream Breaking Schema & Extraction Contract Change",
                 "Upstream Source Database / API Contract"),
    "replay": (0.92, "Non-Idempotent Pipeline Extraction or Message Replay",
               "ETL Ingestion & Message Broker Queue"),
    "outliers": (0.88, "Upstream Numerical Calculation or Sensor Data Drift",
                 "ETL Transformation & Domain Feature Engineering"),
    "drift": (0.86, "Statistical Distribution Shift / Concept Drift",
              "Source Environment / Seasonal Consumer Behavior"),
}
REPLAY_PCT = 10.0
TOP_CAUSES = 5


def _by_type(values: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for kind, value in values.items():
        cond = F.col("finding_type") == kind
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def root_cause_candidates(findings: DataFrame) -> DataFrame:
    """One candidate per evidence item, by its finding type."""
    e = evidence_items(findings)
    severity = F.concat(F.lit("Finding severity was "), "severity", F.lit("."))
    pct = F.col("affected_pct").cast("string")
    col, exp, act = F.col("column_name"), F.col("expected_type"), F.col("actual_type")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    evidence = _by_type({
        "MISSING_VALUES": F.array(text("Column '", col, "' contains ", pct, "% missing values."), severity),
        "DUPLICATE_RECORDS": F.array(
            text("Duplicate records represent ", pct, "% of the dataset."), severity),
        "COLUMN_REMOVED": F.array(text("Expected column '", col, "' was not found."),
                                  text("Expected data type was '", exp, "'.")),
        "COLUMN_ADDED": F.array(text("Unexpected column '", col, "' was detected."),
                                text("Actual data type was '", act, "'.")),
        "COLUMN_TYPE_CHANGED": F.array(
            text("Column '", col, "' changed from '", exp, "' to '", act, "'.")),
    }, F.array("message"))
    return e.select(
        F.col("position").alias("cause_order"), "evidence_id",
        _by_type({k: F.lit(v[1]) for k, v in CAUSES.items()},
                 text("Potential issue associated with ", F.col("finding_type"), ".")).alias("cause"),
        _by_type({k: F.lit(v[0]) for k, v in CAUSES.items()}, F.lit(OTHER_CAUSE[0])).alias("confidence"),
        F.array_join(evidence, " ").alias("evidence"),
        _by_type({k: F.lit(v[2]) for k, v in CAUSES.items()}, F.lit(OTHER_CAUSE[1]))
        .alias("affected_area"),
        F.lit("INDIVIDUAL").alias("level"))


def root_cause_patterns(findings: DataFrame) -> DataFrame:
    """Candidates that need several findings together; later ones stand further in front."""
    def has(*types):
        return F.bool_or(F.col("finding_type").isin(*types))

    f = findings.agg(
        (has("COLUMN_REMOVED", "COLUMN_TYPE_CHANGED")
         & has("MISSING_VALUES", "DUPLICATE_RECORDS")).alias("contract"),
        F.max(F.when(F.col("finding_type") == "DUPLICATE_RECORDS", F.col("affected_pct"))).alias("pct"),
        has("ML_ISOLATION_FOREST_ANOMALY", "NUMERICAL_OUTLIERS").alias("outliers"),
        has("DISTRIBUTION_DRIFT").alias("drift"),
        F.array_join(F.array_sort(F.collect_set("finding_type")), ", ").alias("types"))
    flag = {"contract": F.col("contract"), "replay": F.col("pct") > REPLAY_PCT,
            "outliers": F.col("outliers"), "drift": F.col("drift")}
    evidence = {
        "contract": F.concat(
            F.lit("Simultaneous occurrence of schema drift and data quality failure. "
                  "Observed finding types: "), "types"),
        "replay": F.concat(F.lit("High duplicate rate of "), num(F.col("pct"), 1),
                           F.lit("%. Target table lacks unique composite key constraints.")),
        "outliers": F.lit("Unsupervised Isolation Forest flagged multivariate outliers. "
                          "Univariate numerical distribution bounds violated."),
        "drift": F.lit("Two-sample Kolmogorov-Smirnov test rejected null hypothesis of "
                       "identical distributions."),
    }
    rows = [F.when(flag[k], F.struct(
                F.lit(-i).alias("cause_order"), F.lit(None).cast("string").alias("evidence_id"),
                F.lit(cause).alias("cause"), F.lit(conf).alias("confidence"),
                evidence[k].alias("evidence"), F.lit(area).alias("affected_area"),
                F.lit("CROSS_FINDING_SYNTHESIS").alias("level")))
            for i, (k, (conf, cause, area)) in enumerate(PATTERNS.items(), start=1)]
    return f.select(F.inline(F.array_compact(F.array(*rows))))


def ranked_causes(findings: DataFrame) -> DataFrame:
    """All candidates by falling confidence; equal ones keep their order."""
    every = root_cause_candidates(findings).unionByName(root_cause_patterns(findings))
    order = Window.orderBy(F.desc("confidence"), "cause_order")
    return every.withColumn("rank", F.row_number().over(order))


def primary_cause(findings: DataFrame) -> DataFrame:
    ranked = ranked_causes(findings)
    return ranked.agg(
        F.count_if(F.col("level") == "INDIVIDUAL").alias("finding_count"),
        F.coalesce(F.min_by("cause", "rank"), F.lit("Unknown")).alias("primary_cause"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("overall_confidence"))


def top_causes(findings: DataFrame, k: int = TOP_CAUSES) -> DataFrame:
    return ranked_causes(findings).orderBy("rank").limit(k).select("rank", "cause", "confidence")


# fixed values: finding type -> (category, priority, action type, impact)
RECOMMENDATIONS = {
    "MISSING_VALUES": ("DATA_QUALITY", None, "IMPUTE_OR_QUARANTINE",
                       "Prevents downstream null-pointer exceptions and protects analytics reporting."),
    "DUPLICATE_RECORDS": ("DATA_INTEGRITY", "P0_CRITICAL", "DEDUPLICATION",
                          "Eliminates inflated KPIs and prevents double-billing or phantom inventory."),
    "COLUMN_REMOVED": ("SCHEMA_EVOLUTION", "P0_CRITICAL", "SCHEMA_RESTORATION",
                       "Maintains backwards compatibility for downstream pipelines and BI dashboards."),
    "COLUMN_ADDED": ("SCHEMA_EVOLUTION", "P2_MEDIUM", "SCHEMA_EXPANSION",
                     "Enables safe capture of new upstream domain attributes."),
    "COLUMN_TYPE_CHANGED": ("SCHEMA_EVOLUTION", "P1_HIGH", "TYPE_CASTING",
                            "Prevents runtime typing exceptions in downstream analytical engines."),
    "ML_ISOLATION_FOREST_ANOMALY": ("ML_ANOMALY", "P1_HIGH", "OUTLIER_QUARANTINE",
                                    "Isolates corrupted metrics while allowing clean batch records "
                                    "to proceed."),
    "NUMERICAL_OUTLIERS": ("ML_ANOMALY", "P1_HIGH", "OUTLIER_QUARANTINE",
                           "Isolates corrupted metrics while allowing clean batch records to proceed."),
}
OUTLIER_RATIONALE = ("Multivariate / numerical boundary violation detected. May indicate currency "
                     "unit confusion, decimal placement error, or sensor failure.")


def recommendations(findings: DataFrame) -> DataFrame:
    """One per finding that has a remedy, numbered in finding order, then by priority.
    Drift has no remedy."""
    known = findings.where(F.col("finding_type").isin(*RECOMMENDATIONS))
    rows = numbered(known, "REC-", "rec_id", width=3)
    col = F.coalesce("column_name", F.lit("target_column"))
    n, pct = F.col("affected_count").cast("string"), F.col("affected_pct").cast("string")
    exp, act = F.col("expected_type"), F.col("actual_type")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    by_severity = (F.when(F.col("severity") == "CRITICAL", "P0_CRITICAL")
                   .when(F.col("severity") == "HIGH", "P1_HIGH").otherwise("P2_MEDIUM"))
    outlier_title = text("Quarantine Statistical Outliers & Calibrate Bounds for '", col, "'")
    outlier_fix = F.lit(
        "-- Divert outliers into dead-letter queue for manual data steward review\n"
        "INSERT INTO dlq_anomalous_records\nSELECT * FROM current_dataset WHERE is_anomalous = TRUE;")
    title = {
        "MISSING_VALUES": text("Handle Missing Values in Column '", col, "'"),
        "DUPLICATE_RECORDS": F.lit("Deduplicate Dataset and Enforce Unique Constraints"),
        "COLUMN_REMOVED": text("Restore or Backfill Missing Column '", col, "'"),
        "COLUMN_ADDED": text("Register New Column '", col, "' in Schema Registry"),
        "COLUMN_TYPE_CHANGED": text("Add Explicit Type Cast for '", col, "'"),
        "ML_ISOLATION_FOREST_ANOMALY": outlier_title, "NUMERICAL_OUTLIERS": outlier_title,
    }
    rationale = {
        "MISSING_VALUES": text("Detected ", n, " null/missing values (", pct,
                               "%). Unhandled nulls propagate downstream into broken aggregations "
                               "and analytics."),
        "DUPLICATE_RECORDS": text("Found ", n, " duplicate row(s) (", pct,
                                  "%). Duplicates distort metrics like revenue, active users, and "
                                  "inventory counts."),
        "COLUMN_REMOVED": text("Expected column '", col, "' (", exp,
                               ") was omitted from source extract. Downstream consumers will fail "
                               "with column not found errors."),
        "COLUMN_ADDED": text("New column '", col, "' (", act,
                             ") appeared without schema version increment."),
        "COLUMN_TYPE_CHANGED": text("Column '", col, "' type shifted from '", exp, "' to '", act,
                                    "'. May cause silent truncation or parsing failures."),
        "ML_ISOLATION_FOREST_ANOMALY": F.lit(OUTLIER_RATIONALE),
        "NUMERICAL_OUTLIERS": F.lit(OUTLIER_RATIONALE),
    }
    fix = {
        "MISSING_VALUES": text(
            "-- Option A: Quarantine affected records\nINSERT INTO quarantine_", col,
            "_nulls\nSELECT * FROM current_dataset WHERE ", col,
            " IS NULL;\n\n-- Option B: Impute with domain default\nUPDATE current_dataset SET ", col,
            " = 'UNKNOWN' WHERE ", col, " IS NULL;"),
        "DUPLICATE_RECORDS": F.lit(
            "-- Deduplicate keeping earliest record\nDELETE FROM current_dataset a USING "
            "current_dataset b\nWHERE a.ctid < b.ctid AND a.order_id = b.order_id;"),
        "COLUMN_REMOVED": text(
            "-- Add column back with safe fallback value\nALTER TABLE current_dataset ADD COLUMN ",
            col, " ", exp, " DEFAULT NULL;\n-- Notify upstream producer team to verify extraction "
            "query select list."),
        "COLUMN_ADDED": text(
            "-- Update expected schema definition\nexpected_schema['", col, "'] = '", act,
            "';\n-- Update target DDL to persist newly available attributes."),
        "COLUMN_TYPE_CHANGED": text(
            "-- Apply safe explicit conversion in ETL transformation stage\nSELECT CAST(", col,
            " AS ", exp, ") AS ", col, " FROM raw_stage;"),
        "ML_ISOLATION_FOREST_ANOMALY": outlier_fix, "NUMERICAL_OUTLIERS": outlier_fix,
    }
    target = _by_type({"DUPLICATE_RECORDS": F.lit("ALL_COLUMNS")}, col)

    def fixed(i):
        return _by_type({k: F.lit(v[i]) if v[i] else by_severity
                         for k, v in RECOMMENDATIONS.items()}, F.lit(None))

    return (rows.select(
        "rec_id", fixed(0).alias("category"), fixed(1).alias("priority"),
        _by_type(title, F.lit(None)).alias("title"), F.col("finding_type").alias("finding_ref"),
        target.alias("target_column"), _by_type(rationale, F.lit(None)).alias("rationale"),
        fixed(2).alias("action_type"), _by_type(fix, F.lit(None)).alias("suggested_fix"),
        fixed(3).alias("impact"))
        .orderBy("priority", "rec_id"))
