"""Streaming forms of the audit and of the run counters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import shared_dir


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files called ``name`` in ``folder`` as a stream."""
    schema = spark.read.parquet(os.path.join(folder, name)).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_counters(events: DataFrame, output_below: float = 100.0, lateness: str = "1 day") -> DataFrame:
    """Daily counters per event type, the raw material of the run history.

    State is one row per (day, type) until the watermark closes the day.
    """
    return (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
            .groupBy(F.window("ts", "1 day"), "event_type")
            .agg(F.count(F.lit(1)).alias("rows_input"),
                 F.count_if(F.col("value") < output_below).alias("rows_output"),
                 F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"))
            .select(F.col("event_type").alias("pipeline_id"),
                    F.date_format("window.start", "yyyy-MM-dd").alias("day"),
                    "rows_input", "rows_output",
                    F.expr("timestampdiff(MICROSECOND, started_at, completed_at) / 1000.0D")
                    .alias("duration_ms")))


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available, appended exactly once to a Parquet table."""
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", base + "-state").trigger(availableNow=True)
             .start(base))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base)


def run_upserts(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Process everything available; the newest state of each key, open windows included.

    Every batch writes what it changed to a folder of its own, so a repeated batch
    overwrites its own rows; the row of the latest batch stands for its key.
    """
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")

    def one(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .parquet(os.path.join(base, f"batch={batch_id}")))

    (stream.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", base + "-state")
     .trigger(availableNow=True).start().awaitTermination())
    schema = stream.schema.add("_batch", "long")
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(base)
    newest = F.max_by(F.struct(*stream.columns), "_batch").alias("row")
    return rows.groupBy(*keys).agg(newest).select("row.*")


def audit_stream(stream: DataFrame, audit: Callable[[DataFrame], DataFrame], target: str,
                 state: str) -> None:
    """Audit each micro-batch; findings land in a folder named after the batch, so a
    repeated batch overwrites its own result and nothing is counted twice."""

    def one(batch: DataFrame, batch_id: int) -> None:
        (audit(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .parquet(os.path.join(target, f"batch={batch_id}")))

    (stream.writeStream.foreachBatch(one).option("checkpointLocation", state)
     .trigger(availableNow=True).start().awaitTermination())


def audited_stream(stream: DataFrame, audit: Callable[[DataFrame], DataFrame], name: str = "stream-audit") -> DataFrame:
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    audit_stream(stream, audit, base, base + "-state")
    return spark.read.option("recursiveFileLookup", True).parquet(base)
