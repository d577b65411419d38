"""Reading data sets by format, and the row rules of loose files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


def format_of(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported dataset format: {ext or path!r}; known: {sorted(FORMATS)}")
    return FORMATS[ext]


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, *, multiline: bool | None = None) -> DataFrame:
    """Dispatch by extension (or the given format).

    ``multiline`` has no default for text formats, since either choice can be wrong: true
    reads records with line breaks, and JSON documents, as one split a file; false splits
    large files and takes every line for a record.
    """
    readers = {"csv": lambda s, p: read_csv(s, p, multiline), "json": lambda s, p: read_json(s, p, lines=not multiline),
               "parquet": lambda s, p: s.read.parquet(p)}
    fmt = fmt or format_of(path)
    if fmt not in readers:
        raise ValueError(f"unsupported dataset format: {fmt}; known: {sorted(readers)}")
    if multiline is None and fmt != "parquet":
        raise ValueError(f"say whether records of this {fmt} may span lines (multiline)")
    return readers[fmt](spark, path)


def read_csv(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """Header required, every value a string, empty quoted cells stay empty text.

    ``multiline`` allows line breaks inside quotes but makes each file one split;
    switch it off for large files that have none.
    """
    return (spark.read.option("header", True).option("multiLine", multiline)
            .option("escape", '"').option("encoding", "UTF-8")
            .option("nullValue", "\u0000").option("emptyValue", "").csv(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, *,
              lines: bool) -> DataFrame:
    """A top-level array of objects, or an object that wraps it as ``data``.

    Such a document is one split; ``lines`` reads one object per line instead,
    which splits and is what large data should use.
    """
    reader = spark.read.option("multiLine", not lines)
    df = (reader.schema(schema) if schema else reader).json(path)
    if df.columns == ["data"] and isinstance(df.schema["data"].dataType, T.ArrayType) \
            and isinstance(df.schema["data"].dataType.elementType, T.StructType):
        return df.selectExpr("inline(data)")
    return df


def normalised_headers(df: DataFrame) -> DataFrame:
    """Trimmed header names; an empty header becomes column_<position>."""
    return df.toDF(*[name.strip() or f"column_{i}" for i, name in enumerate(df.columns, 1)])


def drop_blank_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def first_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows in key order: a bounded sample, ordered by top-n, not by a full sort."""
    return df.orderBy(*keys).limit(n)


#: Session setting: parts over which scans are dealt out; unset or 0 leaves them as they are.
SCAN_PARTS = "spark.assayer.scanParts"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out over as many parts as the session asks for.

    Auditing passes over the rows several times; a file that is one split keeps one core
    busy in each pass.  Off unless set: large tables have splits enough.
    """
    parts = int(df.sparkSession.conf.get(SCAN_PARTS, "0"))
    return df.repartition(parts) if parts else df
