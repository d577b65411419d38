"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that map A-Z to a-z and leave all others, those of UTF-8 sequences included.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def fresh(stem: str, columns: Iterable[str]) -> str:
    """A column name that clashes with none of the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    name, n = f"_{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{stem}_{n}"
    return name


def slices(texts: Sequence[str], limit: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with about ``limit`` characters, so that what a task
    builds per run does not follow the size of an Arrow batch."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total > limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def in_slices(batches: Iterator[pd.DataFrame], text: str, work: Callable[[pd.DataFrame], pd.DataFrame],
              limit: int = 8_000_000) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a, b in slices(batch[text].tolist(), limit):
            yield work(batch.iloc[a:b])


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Arrow batches of about ``size`` for what is run (not only planned) in the block.

    A batch of long texts is held several times over, in the JVM, in Arrow and in pandas, by
    each task of an executor at once; how it is cut does not change a result.
    """
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


#: What a Python worker keeps from task to task, such as a compiled vocabulary.
kept: dict[str, object] = {}


def settle(forget: bool = True) -> None:
    """Give memory that is free back to the system, in a Python worker; with ``forget`` also
    what other operators keep there.

    Spark hands a worker on from stage to stage.  What it has freed stays with Arrow and the
    C library, and so counts beside the next stage until it is given back.
    """
    if forget:
        kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def remainder5(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))
