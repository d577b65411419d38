"""An audit that remembers: mergeable state of a data set that arrives in batches.

Each batch leaves one part of state: missing cells with their first key, moments of the
numbers, and the digests of its rows with their copies.  Parts of the same kind add up, so
findings over all batches come from state alone, and copies that arrive in two batches
are found though neither batch holds both.

Parts form levels of ``FANOUT``: the batch that completes a run of eight parts merges them
into one of the next level.  A row's digest is rewritten once a level, so the work of n
batches is n log n, and a reader opens at most seven parts of each level.  Which parts count
follows from the number of batches alone; they lie in folders named by it.  A batch that
is run again writes the same folders again and counts once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.expr import measured_columns
from assayer.operators.findings import union_findings
from assayer.operators.quality import (duplicate_findings_of, duplicate_totals, missing_counts, missing_findings_of, row_digest)
from assayer.operators.quantiles import column_moments
from assayer.session import shared_dir

FANOUT = 8


def live_parts(batches: int) -> list[tuple[int, int]]:
    """(level, number) of the parts that hold the first ``batches`` batches: the digits of that number."""
    parts, level = [], 0
    while batches:
        whole, loose = divmod(batches, FANOUT)
        parts += [(level, whole * FANOUT + i) for i in range(loose)]
        batches, level = whole, level + 1
    return parts


def merged_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("column").agg(
        F.min("ordinal").alias("ordinal"), F.sum("missing_count").alias("missing_count"),
        F.sum("total_rows").alias("total_rows"), F.min("first_key").alias("first_key"))


def merged_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.sum("copies").alias("copies"))


def merged_moments(moments: DataFrame) -> DataFrame:
    """Count, mean and sum of squared deviations of the union.  Deviations of the parts' means
    are taken from the common mean, so nothing large cancels."""
    one = Window.partitionBy("column")  # a row per part
    near = moments.withColumn("all", F.sum(F.col("n") * F.col("mean")).over(one) / F.sum("n").over(one))
    return near.groupBy("column").agg(
        F.min("ordinal").alias("ordinal"), F.sum("n").alias("n"), F.max("all").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all"), F.lit(2))).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"))


MERGED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "cells": merged_cells, "rows": merged_rows, "moments": merged_moments}


class AuditMemory:
    """State under ``root``, a folder that all executors share.

    ``order_key`` names the column whose smallest value says where a column first lacks a
    cell; ``columns`` are those whose moments are kept.
    """

    def __init__(self, spark: SparkSession, root: str, order_key: str, columns: Iterable[str] | None = None):
        self.spark, self.root, self.order_key = spark, root, order_key
        self.columns = None if columns is None else list(columns)

    def _path(self, kind: str, level: int, number: int) -> str:
        return os.path.join(self.root, kind, f"{level}-{number}")

    def _read(self, kind: str, parts: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[self._path(kind, *p) for p in parts])

    def add(self, batch: DataFrame, number: int) -> None:
        """Remember batch ``number``; batches are numbered from 0 without gaps."""
        names = measured_columns(batch) if self.columns is None else self.columns
        batch = batch.persist()  # three passes over one batch
        try:
            parts = {"cells": missing_counts(batch, self.order_key),
                     "rows": batch.groupBy(row_digest(batch).alias("digest")).agg(F.count(F.lit(1)).alias("copies"))}
            if names:
                parts["moments"] = column_moments(batch, names).where("n > 0").select(
                    "column", "ordinal", "n", "mean", (F.col("std") * F.col("std") * F.col("n")).alias("m2"), "min", "max")
            for kind, part in parts.items():
                part.write.mode("overwrite").parquet(self._path(kind, 0, number))
        finally:
            batch.unpersist()
        level, count = 0, number + 1
        while count % FANOUT == 0:  # this batch completes a part of the next level
            count //= FANOUT
            below = [(level, (count - 1) * FANOUT + i) for i in range(FANOUT)]
            for kind in parts:
                MERGED[kind](self._read(kind, below)).write.mode("overwrite").parquet(self._path(kind, level + 1, count - 1))
            level += 1

    def state(self, kind: str, batches: int) -> DataFrame:
        """cells, rows or moments of the first ``batches`` batches."""
        if batches < 1:
            raise ValueError("nothing is remembered before the first batch")
        return MERGED[kind](self._read(kind, live_parts(batches)))

    def findings(self, batches: int) -> DataFrame:
        """Findings of missing cells and copies over all of these batches, from state alone."""
        return union_findings([
            missing_findings_of(self.state("cells", batches)),
            duplicate_findings_of(duplicate_totals(self.state("rows", batches)))])

    def profile(self, batches: int) -> DataFrame:
        """(column, n, mean, std, min, max) over all of these batches."""
        return self.state("moments", batches).select(
            "column", "n", F.round("mean", 4).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 4).alias("std"),
            F.round("min", 4).alias("min"), F.round("max", 4).alias("max"))

    def vacuum(self, batches: int) -> None:
        """Remove parts that neither these batches nor, should the last be run again, its merges read."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        kept = {f"{lev}-{n}" for b in (batches, batches - 1) for lev, n in live_parts(max(b, 0))}
        for kind in MERGED:
            folder = fs_path(os.path.join(self.root, kind))
            fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for entry in fs.listStatus(folder) if fs.exists(folder) else []:
                if entry.getPath().getName() not in kept:
                    fs.delete(entry.getPath(), True)


def remembered(stream: DataFrame, order_key: str, root: str | None = None,
               columns: Iterable[str] | None = None) -> tuple[AuditMemory, int]:
    """Take in everything that is available; the memory and the number of batches it holds.

    State and progress of the stream lie under ``root``: a later call with the same folder goes on
    where this one ended.
    """
    spark = stream.sparkSession
    root = root or os.path.join(shared_dir(spark), f"memory-{uuid.uuid4().hex}")
    memory = AuditMemory(spark, root, order_key, columns)
    seen = (stream.writeStream.foreachBatch(memory.add).option("checkpointLocation", os.path.join(root, "progress"))
            .trigger(availableNow=True).start())
    seen.awaitTermination()
    commits = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(root, "progress", "commits"))
    fs = commits.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [e.getPath().getName() for e in fs.listStatus(commits)] if fs.exists(commits) else []
    return memory, max([int(n) + 1 for n in names if n.isdigit()], default=0)
