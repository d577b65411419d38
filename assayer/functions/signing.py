"""Canonical audit record, its digest and its keyed signature."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL_VERSION = 1


def canonical_findings(findings: DataFrame) -> DataFrame:
    """Findings reduced to the signed fields, in signing order."""
    order = Window.orderBy("type", "column", "severity", "message")  # few rows: one audit
    return (findings.select(
                F.coalesce("finding_type", F.lit("UNKNOWN")).alias("type"),
                F.coalesce("severity", F.lit("LOW")).alias("severity"),
                F.coalesce("column_name", F.lit("")).alias("column"),
                F.coalesce("message", F.lit("")).alias("message"))
            .withColumn("position", F.row_number().over(order)))


def canonical_record(findings: DataFrame, dataset_path: str, row_count: Column, column_count: int,
                     status: Column, highest: Column) -> DataFrame:
    """One row with the JSON text that is hashed: fixed field order, UTF-8, versioned."""
    item = F.struct("position", F.struct("type", "severity", "column", "message").alias("f"))
    sorted_items = F.transform(F.array_sort(F.collect_list(item)), lambda s: s["f"])
    one = canonical_findings(findings).agg(F.count(F.lit(1)).alias("finding_count"),
                                           sorted_items.alias("findings"))
    record = F.struct(
        F.lit(CANONICAL_VERSION).alias("v"), F.lit(dataset_path).alias("dataset_path"),
        status.alias("status"), highest.alias("highest_severity"), row_count.alias("row_count"),
        F.lit(column_count).alias("column_count"), F.col("finding_count"), F.col("findings"))
    return one.select(F.to_json(record).alias("record"))


def audit_hash(record: DataFrame) -> DataFrame:
    return record.select(F.sha2("record", 256).alias("audit_hash"))


def hmac_sha256(text: Column, secret: bytes) -> Column:
    """Keyed signature.  The key stays in the function's closure, out of the query
    plan and so out of logs; it has no default."""
    if not secret:
        raise ValueError("a secret is required")

    @F.pandas_udf(T.StringType())
    def sign(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else
                         hmac.new(secret, t.encode("utf-8"), hashlib.sha256).hexdigest())

    return sign(text)


def verify_integrity(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Compare stored digests with recomputed ones; unsigned rows count as legacy.

    stored(inspection_id, audit_hash), recomputed(inspection_id, audit_hash)
    """
    r = recomputed.select("inspection_id", F.col("audit_hash").alias("computed_hash"))
    verdict = (F.when(F.col("audit_hash").isNull(), "LEGACY_UNSIGNED")
               .when(F.col("audit_hash") == F.col("computed_hash"), "VALID").otherwise("TAMPERED"))
    return (stored.join(r, "inspection_id", "left")
            .select("inspection_id", verdict.alias("integrity"),
                    (verdict != "TAMPERED").alias("is_valid")))
