"""What each detection method did, as one row per method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.drift import drift_status
from assayer.operators.forest import ForestResult
from assayer.operators.outliers import method_proofs

# fixed values
FOREST, KS = "Isolation Forest", "Kolmogorov-Smirnov Two-Sample Test"


def forest_proof(df: DataFrame, found: ForestResult | None) -> DataFrame:
    """The forest's row; NOT_APPLICABLE where no column can be a feature."""
    if found is None:
        none = F.lit("NOT_APPLICABLE")
        return df.limit(0).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(0).cast("long").alias("columns_analyzed"), F.lit(FOREST).alias("method"), none.alias("execution_status"),
            none.alias("status"), F.lit(0).cast("long").alias("total_flagged_count"), F.lit(None).cast("long").alias("samples"))
    n = F.col("n")
    return found.flagged.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(len(found.features)).cast("long").alias("columns_analyzed"), F.lit(FOREST).alias("method"),
        F.lit("EXECUTED").alias("execution_status"),
        F.when(n > 0, "ANOMALY_DETECTED").otherwise("HEALTHY").alias("status"), n.alias("total_flagged_count"),
        F.lit(found.rows).cast("long").alias("samples"))


def ks_proof(tested: DataFrame, reference: DataFrame | None) -> DataFrame:
    """The drift test's row; NOT_EXECUTED without a reference of ten rows."""
    s = drift_status(tested, reference)
    ran = F.col("status") != "NOT_EXECUTED"
    return s.select(
        F.when(ran, F.col("columns_tested")).otherwise(F.lit(0)).cast("long").alias("columns_analyzed"),
        F.lit(KS).alias("method"), F.when(ran, "EXECUTED").otherwise("NOT_EXECUTED").alias("execution_status"), "status",
        F.when(ran, F.col("drift_detected_count")).otherwise(F.lit(0)).cast("long").alias("total_flagged_count"),
        F.lit(None).cast("long").alias("samples"))


def all_proofs(measures: DataFrame, df: DataFrame, found: ForestResult | None, tested: DataFrame,
               reference: DataFrame | None) -> DataFrame:
    """Z-score, IQR, forest and drift test, one row each."""
    return (method_proofs(measures).withColumn("samples", F.lit(None).cast("long"))
            .unionByName(forest_proof(df, found), allowMissingColumns=True)
            .unionByName(ks_proof(tested, reference), allowMissingColumns=True))
