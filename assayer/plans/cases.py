"""The tables that the registered queries audit, derived from the given ones.

The given tables are clean, so the faults of operators.faults are written into
them by key, the same way at every scale.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.faults import (inject_duplicates, inject_missing, inject_outliers,
                                      inject_schema_drift)
from assayer.operators.forest import ForestModel
from assayer.operators.runs import fold_runs
from assayer.operators.schema import infer_schema
from assayer.plans.audit import audit
from assayer.sources.readers import spread

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(os.path.join(sf, f"{name}.parquet")))


def faulted_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """All four faults, and prices counted twice (a factor that keeps whole cents, so
    that quartiles have no rounding ties at four digits)."""
    df = inject_missing(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey", 5)
    df = inject_missing(df, "l_returnflag", "l_suppkey", 7, blank=" ")
    df = inject_duplicates(df, F.col("l_orderkey") % 8 == 0)
    df = inject_outliers(inject_schema_drift(df), "l_orderkey", 5, "l_quantity")
    return df.withColumn("l_extendedprice", F.col("l_extendedprice") * 2.0)


def faulted_orders(spark: SparkSession, sf: str) -> DataFrame:
    df = inject_missing(table(spark, sf, "orders"), "o_custkey", "o_orderkey", 5)
    df = inject_missing(df, "o_orderpriority", "o_orderkey", 7, blank=" ")
    df = inject_missing(df, "o_orderpriority", "o_orderkey", 11, blank="UNKNOWN")
    df = inject_missing(df, "o_totalprice", "o_orderkey", 13)
    df = inject_duplicates(df, F.col("o_orderkey") % 8 == 0)
    return inject_outliers(df, "o_orderkey", 5, "o_totalprice")


def faulted_customer(spark: SparkSession, sf: str) -> DataFrame:
    df = inject_missing(table(spark, sf, "customer"), "c_name", "c_custkey", 5)
    return inject_outliers(df, "c_custkey", 5, "c_acctbal")


def scaled_events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(current, reference): the second half of the month scaled, the first half as it is."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    split = F.lit("2024-01-16").cast("timestamp")
    return (e.where(F.col("ts") >= split).withColumn("value", F.col("value") * 1.5),
            e.where(F.col("ts") < split))


def fixed_forest(trees: int = 5) -> ForestModel:
    """A small forest given as numbers, the same at every scale, so that SQL can score it too.

    Tree t parts quantities of 100 (t + 1) and more at its root, which isolates them, and the
    rest by price, discount or tax in turn.
    """
    t = np.arange(trees)
    limit = np.stack([50_000.0 + 10_000 * t, 0.01 * (t + 3), 0.01 * (t + 2)], axis=1)[t, t % 3]
    return ForestModel(
        ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), (0.0,) * 4, 0,
        split=np.stack([0 * t, 1 + t % 3, 0 * t], axis=1),
        at=np.stack([100.0 * (t + 1), limit, np.full(trees, np.inf)], axis=1),
        length=np.tile([1.0, 1.1, 0.1, 0.1], (trees, 1)), levels=2)


def line_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Every stage of an audit."""
    clean = table(spark, sf, "lineitem")
    return audit(faulted_lineitem(spark, sf), order_key="l_orderkey", expected=infer_schema(clean), reference=clean,
                 forest_keys=LINE_KEYS, forest_model=fixed_forest())


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Create and update records of daily runs per event type, in append order."""
    daily = (table(spark, sf, "events")
             .groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
             .agg(F.min("ts").alias("first"), F.max("ts").alias("last"),
                  F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 100).alias("kept")))
    none, text = F.lit(None), F.lit(None).cast("string")
    run = F.concat_ws("|", "event_type", "day").alias("run_id")
    stream_id = F.when(F.col("event_type") != "error", "events").alias("dataset_id")
    records = F.array(
        F.struct(F.lit(1).alias("seq"), F.col("event_type").alias("pipeline_id"), stream_id,
                 F.col("first").alias("started_at"), none.cast("timestamp").alias("completed_at"),
                 F.lit("RUNNING").alias("status"), F.col("n").alias("rows_input"),
                 none.cast("long").alias("rows_output"), none.cast("double").alias("duration_ms")),
        F.struct(F.lit(2).alias("seq"), text.alias("pipeline_id"), text.alias("dataset_id"),
                 none.cast("timestamp").alias("started_at"), F.col("last").alias("completed_at"),
                 F.lit("SUCCESS").alias("status"), none.cast("long").alias("rows_input"),
                 F.col("kept").alias("rows_output"), none.cast("double").alias("duration_ms")))
    return daily.select(run, F.inline(records))


def etl_runs(spark: SparkSession, sf: str) -> DataFrame:
    return fold_runs(run_log(spark, sf))
