"""Column and dataset profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expr import (as_text, data_type, float_sql, ident, literal, long_numbers,
                                    may_be_numeric, missing, missing_sql, numeric, ordinals, quoted)
from assayer.operators.quality import duplicate_counts, quality_score, tiny
from assayer.operators.quantiles import column_summary

_CHUNK = 100


def cell_counts(df: DataFrame) -> DataFrame:
    """(column, ordinal, total_count, valid_count, numeric_count, floatable_count), one scan."""
    pos = ordinals(df)
    parts = []
    for start in range(0, len(df.columns), _CHUNK):
        names = df.columns[start:start + _CHUNK]
        aggs, rows = [F.expr("count(1) as total")], []
        for c in names:
            i, dtype = pos[c], data_type(df, c)
            if isinstance(dtype, T.StringType):
                floatable = F.expr(f"count_if({float_sql(ident(c))})")
            elif may_be_numeric(dtype):
                floatable = F.count(quoted(c))
            else:
                floatable = F.lit(0).cast("long")
            aggs += [F.expr(f"count_if(not {missing_sql(df, c)}) as v{i}"),
                     F.count(numeric(df, c)).alias(f"n{i}"), floatable.alias(f"f{i}")]
            rows.append(f"struct({literal(c)} as column, {i} as ordinal, total as total_count, "
                        f"v{i} as valid_count, n{i} as numeric_count, f{i} as floatable_count)")
        parts.append(df.agg(*aggs).select(F.expr(f"inline(array({', '.join(rows)}))")))
    return tiny(parts)


def _with_missing(counts: DataFrame) -> DataFrame:
    gone = F.col("total_count") - F.col("valid_count")
    return (counts.withColumn("missing_count", gone)
            .withColumn("missing_percentage",
                        F.round(F.try_divide(gone, F.col("total_count")) * 100, 2)))


def _is_numeric():
    return (F.col("numeric_count") == F.col("valid_count")) & (F.col("valid_count") > 0)


def profile_numeric(df: DataFrame) -> DataFrame:
    """Columns whose every valid value is a number: moments and quartiles."""
    columns = [f.name for f in df.schema.fields if may_be_numeric(f.dataType)]
    counts = _with_missing(cell_counts(df)).where(_is_numeric())
    stats = column_summary(df, columns).drop("ordinal")
    # both sides have at most one row per column
    return (counts.join(stats, "column")
            .select("column", F.lit("numeric").alias("data_type"), "total_count", "valid_count",
                    "missing_count", "missing_percentage",
                    *[F.round(F.col(c), 4).alias(c)
                      for c in ("mean", "std", "min", "max", "q25", "median", "q75")],
                    F.round(F.col("q75") - F.col("q25"), 4).alias("iqr")))


def profile_categorical(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Columns with at least one valid value that is not a number: distinct texts.

    Only those columns' texts are grouped; equal texts combine before the
    shuffle, so one dominant value costs one row per task.
    """
    counts = _with_missing(cell_counts(df)).where(~_is_numeric())
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(~missing(df, c), as_text(df, c)).alias("text"))
        for c in df.columns if not isinstance(data_type(df, c), T.IntegralType)
    ])
    texts = (df.select(F.inline(cells)).where(F.col("text").isNotNull())
             .join(F.broadcast(counts.select("column")), "column"))  # one row per column
    if approximate:
        distinct = texts.groupBy("column").agg(F.approx_count_distinct("text").alias("unique_count"))
    else:
        # long texts travel as digests, which are longer than what is called short
        short = F.when(F.length("text") > 64, F.concat(F.lit("#"), F.sha2("text", 256))).otherwise(F.col("text"))
        distinct = (texts.groupBy("column", short.alias("text")).agg(F.count(F.lit(1)).alias("c"))
                    .groupBy("column").agg(F.count(F.lit(1)).alias("unique_count")))
    return (counts.join(distinct, "column", "left")
            .select("column", F.lit("categorical").alias("data_type"), "total_count", "valid_count",
                    "missing_count", "missing_percentage",
                    F.coalesce("unique_count", F.lit(0)).alias("unique_count")))


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row describing the whole table."""
    counts = _with_missing(cell_counts(df)).withColumn(
        "dtype", F.when((F.col("floatable_count") == F.col("valid_count"))
                        & (F.col("valid_count") > 0), "float64").otherwise("object"))

    def listed(what, condition=None):
        item = F.struct("ordinal", what.alias("x"))
        kept = item if condition is None else F.when(condition, item)
        return F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["x"]), ",")

    pair = F.concat("column", F.lit(":"), "dtype")
    gone = F.concat("column", F.lit(":"), F.col("missing_count").cast("string"))
    summary = counts.agg(
        listed(F.col("column")).alias("column_names"), listed(pair).alias("data_types"),
        listed(gone).alias("missing_values"),
        listed(F.col("column"), F.col("dtype") == "float64").alias("numeric_columns"),
        listed(F.col("column"), F.col("dtype") == "object").alias("categorical_columns"))
    return duplicate_counts(df, "exact").select(
        F.col("total_rows").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
        F.col("duplicate_count").alias("duplicate_rows"),
        summary.select(F.struct("*")).scalar().alias("s")).select("rows", "columns",
                                                                  "duplicate_rows", "s.*")


def analyze_dataset(df: DataFrame) -> DataFrame:
    """Profile and validation side by side in one row."""
    score = quality_score(df).select(F.struct(
        F.col("missing_values").alias("missing_cells"), "empty_column_count", "quality_score",
        "is_valid"))
    return dataset_profile(df).withColumn("q", score.scalar()).select("*", "q.*").drop("q")


def numeric_summary(sample: DataFrame, schema: DataFrame) -> DataFrame:
    """Moments of the integer and float columns of a (bounded) sample."""
    columns = [f.name for f in sample.schema.fields if may_be_numeric(f.dataType)]
    wanted = schema.where(F.col("logical_type").isin("integer", "float")).select("column")
    return (long_numbers(sample, columns).join(F.broadcast(wanted), "column")
            .groupBy("column").agg(
                F.count("value").alias("count"), F.round(F.avg("value"), 4).alias("mean"),
                F.round(F.stddev_pop("value"), 4).alias("std"),
                F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max")))
