"""Propose, authorise, apply and verify repairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expr import (as_text, data_type, missing, num, numeric,
                                    quoted, row_id, stripped)
from assayer.operators.findings import numbered
from assayer.operators.outliers import outlier_stats
from assayer.operators.quality import row_digest
from assayer.operators.quantiles import exact_quantiles
from assayer.session import written

# fixed values
APPROVAL_PCT = 15.0
UNKNOWN = "UNKNOWN"
ACTION_TYPES = {
    "DUPLICATE_RECORDS": "DEDUPLICATE_ROWS",
    "COLUMN_REMOVED": "RESTORE_SCHEMA_COLUMN",
    "COLUMN_ADDED": "ACCEPT_NEW_COLUMN",
    "ML_ISOLATION_FOREST_ANOMALY": "QUARANTINE_ML_OUTLIERS",
    "NUMERICAL_OUTLIERS": "QUARANTINE_ML_OUTLIERS",
}
SQL_TYPES = {"boolean": "boolean", "integer": "bigint", "float": "double",
             "datetime": "timestamp", "string": "string"}


# --- plan ---------------------------------------------------------------------

def propose_actions(findings: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Repair candidates for the findings, with risk and required role.

    ``values`` (column, strategy, impute_value) comes from :func:`impute_values`.
    Type changes and drift have no automatic repair.
    """
    kind, col = F.col("finding_type"), F.col("column_name")
    is_key = F.lower(col).contains("id") | F.lower(col).contains("key")
    action = F.when(kind == "MISSING_VALUES",
                    F.when(is_key, "QUARANTINE_NULL_RECORDS").otherwise("IMPUTE_DEFAULT_VALUE"))
    for finding, name in ACTION_TYPES.items():
        action = action.when(kind == finding, name)
    rows = numbered(findings.withColumn("action_type", action)
                    .where(F.col("action_type").isNotNull()), "ACT-", "action_id", width=3)
    if values is not None:
        rows = rows.join(F.broadcast(values), rows["column_name"] == values["column"], "left")
    else:
        rows = rows.withColumn("strategy", F.lit("MODE")).withColumn("impute_value", F.lit(UNKNOWN))
    impute = F.col("action_type") == "IMPUTE_DEFAULT_VALUE"
    rows = (rows.withColumn("strategy", F.when(impute, F.coalesce("strategy", F.lit("MODE"))))
            .withColumn("impute_value", F.when(impute, F.coalesce("impute_value", F.lit(UNKNOWN)))))
    high = F.col("affected_pct") > APPROVAL_PCT
    outlier = F.col("action_type") == "QUARANTINE_ML_OUTLIERS"
    measured = kind.isin("DUPLICATE_RECORDS", "MISSING_VALUES")
    approval = outlier | (measured & high)
    risk = (F.when(outlier, "MEDIUM")
            .when(measured & high, F.when(kind == "MISSING_VALUES", "HIGH").otherwise("MEDIUM"))
            .otherwise("LOW"))
    target = (F.when(kind == "DUPLICATE_RECORDS", "ALL_ROWS")
              .otherwise(F.coalesce("column_name", F.lit("MULTIVARIATE"))))
    target_type = (F.when(kind == "MISSING_VALUES", "COLUMN")
                   .when(kind.isin("COLUMN_REMOVED", "COLUMN_ADDED"), "SCHEMA").otherwise("DATASET"))
    n = F.coalesce("affected_count", F.lit(0)).cast("string")
    # text values are shown in quotes, numbers as they are
    shown = F.when(F.col("strategy") == "MEDIAN", F.col("impute_value")) \
        .otherwise(F.concat(F.lit("'"), "impute_value", F.lit("'")))
    impact = (
        F.when(kind == "DUPLICATE_RECORDS", F.concat(
            F.lit("Removes "), n, F.lit(" duplicate record(s) ("), num(F.col("affected_pct"), 1),
            F.lit("%).")))
        .when(impute, F.concat(F.lit("Imputes "), n, F.lit(" missing value(s) in '"), col,
                               F.lit("' using "), F.lower("strategy"), F.lit(" ("), shown,
                               F.lit(").")))
        .when(kind == "MISSING_VALUES", F.concat(
            F.lit("Quarantine "), n, F.lit(" rows with null identifier in '"), col,
            F.lit("' to DLQ.")))
        .when(kind == "COLUMN_REMOVED", F.concat(
            F.lit("Backfills missing column '"), col, F.lit("' with default NULL values.")))
        .when(kind == "COLUMN_ADDED", F.concat(
            F.lit("Registers unexpected column '"), col, F.lit("' ("), "actual_type",
            F.lit(") into target schema.")))
        .otherwise(F.concat(F.lit("Quarantines "), n,
                            F.lit(" multivariate outlier records into dlq_anomalies."))))
    return rows.select(
        "action_id", "position", "action_type", target_type.alias("target_type"),
        target.alias("target"), "severity", risk.alias("risk_level"),
        F.when(approval, "REQUIRES_OPERATOR_APPROVAL").otherwise("POLICY_APPROVED")
        .alias("policy_status"),
        F.when(approval, "ADMIN").otherwise("DATA_ENGINEER").alias("required_role"),
        impact.alias("estimated_impact"), "finding_type", "affected_count", "strategy",
        "impute_value", F.coalesce("expected_type", "actual_type").alias("column_type"))


def plan_policy(actions: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return actions.agg(
        n.alias("candidate_count"),
        F.when(F.coalesce(F.bool_or(F.col("risk_level") == "HIGH"), F.lit(False)), "REQUIRES_APPROVAL")
        .otherwise("READY_FOR_EXECUTION").alias("overall_policy"),
        F.count_if(F.col("policy_status") == "REQUIRES_OPERATOR_APPROVAL")
        .alias("requires_approval_count"))


def validate_actions(requested: DataFrame, candidates: DataFrame) -> DataFrame:
    """Match requests with authorised candidates: by id, else by (type, target).

    Two equi joins instead of one OR condition.  Both sides are plans of one audit.
    """
    by_id = candidates.select("action_id", F.struct("action_id", "action_type", "target",
                                                    "risk_level", "policy_status").alias("a"))
    by_pair = candidates.groupBy("action_type", "target").agg(
        F.min(F.struct("action_id", "action_type", "target", "risk_level", "policy_status")).alias("b"))
    matched = (requested.withColumnRenamed("action_id", "requested_id")
               .join(by_id, F.col("requested_id") == by_id["action_id"], "left").drop("action_id")
               .join(by_pair, ["action_type", "target"], "left")
               .withColumn("m", F.coalesce("a", "b")))
    outcome = (F.when(F.col("m").isNull(), "NOT_AUTHORIZED")
               .when(F.col("action_type") != F.col("m.action_type"), "TYPE_MISMATCH")
               .otherwise("AUTHORIZED"))
    return matched.select(
        "request_id", "requested_id", "action_type", "target",
        F.col("m.action_id").alias("matched_id"), outcome.alias("validation"))


def gate_actions(actions: DataFrame, role: str) -> DataFrame:
    """What the role may run now; the rest is skipped with a reason."""
    t = F.lower("target")
    on_key = (F.col("action_type").isin("QUARANTINE_NULL_RECORDS", "DEDUPLICATE_ROWS")
              & (t.endswith("_id") | (t == "id") | t.endswith("_key")))
    risky = ((F.col("risk_level") == "HIGH")
             | (F.col("policy_status") == "REQUIRES_OPERATOR_APPROVAL") | on_key)
    skipped = risky & F.lit(role != "ADMIN")
    reason = F.concat(F.lit("Requires ADMIN approval (Policy status: "), "policy_status",
                      F.lit(f"). Insufficient permissions for role '{role}'."))
    return actions.withColumn("is_high_risk", risky).withColumn(
        "execution_status", F.when(skipped, "SKIPPED_POLICY_RESTRICTION").otherwise("AUTHORIZED")
    ).withColumn("reason", F.when(skipped, reason))


# --- values for missing cells ---------------------------------------------------

def impute_values(df: DataFrame, columns: Sequence[str], order_key: str,
                  treat_unknown_as_missing: bool = True) -> DataFrame:
    """(column, strategy, impute_value): median where numbers prevail, else the most
    frequent text, the first seen on ties, else UNKNOWN.

    One row per column.  Frequencies are combined before the shuffle, so a text
    that fills a third of the table is one partial row per task.
    """
    known = {c: ~missing(df, c) for c in columns}
    if treat_unknown_as_missing:
        for c in columns:
            if isinstance(data_type(df, c), T.StringType):
                known[c] = known[c] & (F.upper(stripped(quoted(c))) != UNKNOWN)
    base = df.select(*[F.when(known[c], quoted(c)).alias(c) for c in columns],
                     quoted(order_key).alias("_order"))
    counts = base.agg(*[F.count(numeric(base, c)).alias(f"n{i}") for i, c in enumerate(columns)],
                      *[F.count(quoted(c)).alias(f"v{i}") for i, c in enumerate(columns)],
                      *[F.bool_and(numeric(base, c) == F.floor(numeric(base, c))).alias(f"w{i}")
                        for i, c in enumerate(columns)])
    stats = counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("numbers"),
                 (F.col(f"v{i}") - F.col(f"n{i}")).alias("texts"), F.col(f"w{i}").alias("whole"))
        for i, c in enumerate(columns)])))
    medians = exact_quantiles(base, columns, {"median": 0.5})
    cells = F.array(*[F.struct(
        F.lit(c).alias("column"),
        F.when(numeric(base, c).isNull(), stripped(as_text(base, c))).alias("text"))
        for c in columns])
    modes = (base.select("_order", F.inline(cells)).where(F.col("text").isNotNull())
             .groupBy("column", "text").agg(F.count(F.lit(1)).alias("c"), F.min("_order").alias("first"))
             .groupBy("column").agg(F.min_by("text", F.struct((-F.col("c")).alias("c"), "first")).alias("mode")))
    number = ((F.col("numbers") > 0) & (F.col("numbers") >= F.col("texts")))
    # Python rounds halves to even
    as_number = F.when(F.col("whole"), F.bround("median", 0).cast("long").cast("string")) \
        .otherwise(F.bround("median", 2).cast("string"))
    return (stats.join(medians, "column", "left").join(modes, "column", "left")
            .select("column", F.when(number, "MEDIAN").otherwise("MODE").alias("strategy"),
                    F.when(number, as_number).otherwise(F.coalesce("mode", F.lit(UNKNOWN)))
                    .alias("impute_value")))


# --- apply ----------------------------------------------------------------------

def deduplicate(df: DataFrame, order_key: str | Sequence[str], normalise: str = "trimmed") -> DataFrame:
    """Keep the first row of each group of equal rows."""
    return split_duplicates(df, order_key, normalise)[0]


def split_duplicates(df: DataFrame, order_key: str | Sequence[str], normalise: str = "trimmed"
                     ) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the first row of each group of equal rows, and its later copies.

    Only digests of rows are grouped, and counts of copies combine before the
    shuffle.  Rows that have no copy pass by; the others are counted by content, so a
    row that fills a third of the table is one partial row per task.  Copies are equal by
    meaning, not by content: the removed rows are those that stood in the table.
    """
    keys = [order_key] if isinstance(order_key, str) else list(order_key)
    marked = df.withColumn("_digest", row_digest(df, normalise))
    several = marked.groupBy("_digest").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    single = marked.join(several, "_digest", "left_anti").drop("_digest")
    copies = marked.join(several, "_digest").select("_digest", F.struct(*[quoted(c) for c in df.columns]).alias("_row"))
    content = F.to_json("_row", {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                                 "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    order = F.struct(*[F.col("_row")[k] for k in keys], content)
    kinds = copies.groupBy("_digest", "_row").agg(F.count(F.lit(1)).alias("_n"))
    groups = kinds.groupBy("_digest").agg(F.min_by("_row", order).alias("_row"), F.min(order).alias("_least"))
    left = F.col("_n") - F.when(order == F.col("_least"), 1).otherwise(0)
    removed = kinds.join(groups.select("_digest", "_least"), "_digest").withColumn("_left", left).where("_left > 0")
    removed = removed.select("_row.*", F.explode(F.sequence(F.lit(1), F.col("_left"))).alias("_copy")).drop("_copy")
    return single.unionByName(groups.select("_row.*")), removed


def quarantine_missing(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) by whether ``column`` has a value."""
    gone = missing(df, column)
    return df.where(~gone), df.where(gone)


def impute(df: DataFrame, column: str, value: Column, treat_unknown_as_missing: bool = True) -> DataFrame:
    """Fill missing cells (and the word UNKNOWN) with ``value``, a literal or a
    scalar subquery over a one-row frame."""
    gone = gaps(df, column, treat_unknown_as_missing)
    # a value that the column's type can't hold (UNKNOWN for an all-null number) leaves the cell null
    return df.withColumn(column, F.when(gone, value.try_cast(data_type(df, column)))
                         .otherwise(quoted(column)))


def gaps(df: DataFrame, column: str, treat_unknown_as_missing: bool = True) -> Column:
    """Cells that :func:`impute` fills."""
    gone = missing(df, column)
    if treat_unknown_as_missing and isinstance(data_type(df, column), T.StringType):
        gone = gone | F.coalesce(F.upper(stripped(quoted(column))) == UNKNOWN, F.lit(False))
    return gone


def impute_from(df: DataFrame, column: str, order_key: str) -> DataFrame:
    """The value is worked out once and written, so that what follows reads one row."""
    value = written(impute_values(df, [column], order_key).select("impute_value"), "value")
    return impute(df, column, value.scalar())


def quarantine_outliers(df: DataFrame, column: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): exactly the rows outside the fences of ``column``.

    The fences are one row, worked out once, written and read as a scalar: no join by
    row is needed, and a chain of such steps does not repeat the ones before it.
    """
    fences = written(outlier_stats(df, [column]).select(F.struct("lower_fence", "upper_fence").alias("f")),
                     "fences").scalar()
    x = numeric(df, column)
    marked = df.withColumn("_f", fences).withColumn("_out", F.coalesce(
        (x < F.col("_f.lower_fence")) | (x > F.col("_f.upper_fence")), F.lit(False)))
    return (marked.where(~F.col("_out")).drop("_f", "_out"),
            marked.where(F.col("_out")).drop("_f", "_out"))


def quarantine_rows(df: DataFrame, flagged: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) by row id, for detectors that report rows."""
    ids = flagged.select("_rid").distinct()
    marked = df.withColumn("_rid", row_id(keys))
    return (marked.join(ids, "_rid", "left_anti").drop("_rid"),
            marked.join(ids, "_rid", "left_semi").drop("_rid"))


def restore_column(df: DataFrame, column: str, logical_type: str = "string") -> DataFrame:
    if column in df.columns:
        return df
    return df.withColumn(column, F.lit(None).cast(SQL_TYPES.get(logical_type, "string")))


def split_action(df: DataFrame, action: dict, keys: Sequence[str], forest_model=None
                 ) -> tuple[DataFrame, DataFrame | None]:
    """(table after the action, rows it set aside or None)."""
    kind, target = action["action_type"], action.get("target")
    if kind == "DEDUPLICATE_ROWS":
        return split_duplicates(df, keys)
    if kind == "QUARANTINE_NULL_RECORDS":
        return quarantine_missing(df, target)
    if kind == "IMPUTE_DEFAULT_VALUE":
        value = action.get("impute_value")
        if value is None or value == UNKNOWN:
            return impute_from(df, target, keys[0]), None
        return impute(df, target, F.lit(value)), None
    if kind == "QUARANTINE_ML_OUTLIERS":
        if target == "MULTIVARIATE":
            from assayer.operators.forest import forest_rows
            return quarantine_rows(df, written(forest_rows(df, keys, model=forest_model).select("_rid"), "flagged"), keys)
        return quarantine_outliers(df, target, keys)
    if kind == "RESTORE_SCHEMA_COLUMN":
        return restore_column(df, target, action.get("column_type") or "string"), None
    return df, None  # ACCEPT_NEW_COLUMN changes the expected schema, not the rows


def apply_action(df: DataFrame, action: dict, keys: Sequence[str]) -> DataFrame:
    return split_action(df, action, keys)[0]


# actions that read their whole input to find out what to do
_MEASURING = ("DEDUPLICATE_ROWS", "QUARANTINE_ML_OUTLIERS", "IMPUTE_DEFAULT_VALUE")


def run_actions(df: DataFrame, actions: Sequence[dict], keys: Sequence[str], forest_model=None
                ) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(repaired table, rows set aside, log): each action on the result of the one before.

    An action that measures its input reads a written table, so the work is linear
    in the number of actions.  Rows set aside carry the step, action and target;
    columns that appear later are null in them.  The log has one row per action:
    rows or cells affected, counts before and after.  Only these counts, a row per action, reach the driver.
    """
    spark, log, aside, current, stored = df.sparkSession, [], [], df, False
    n = None
    for step, action in enumerate(actions, start=1):
        kind, target = action["action_type"], action.get("target")
        if kind in _MEASURING and step > 1 and not stored:
            current, stored = written(current, "step"), True
        after, gone = split_action(current, action, keys, forest_model)
        if n is None:
            n = current.count()
        affected, status, left = 0, "SUCCESS", n
        if gone is not None:
            gone = written(gone, "aside")
            affected = gone.count()
            left = n - affected
            aside.append(gone.select("*", F.lit(step).alias("_step"), F.lit(kind).alias("_action_type"),
                                     F.lit(target).alias("_target")))
        elif kind == "IMPUTE_DEFAULT_VALUE":
            before = current.agg(F.count_if(missing(current, target))).first()[0]
            affected = before - after.agg(F.count_if(missing(after, target))).first()[0]
            status = "SUCCESS" if affected or not before else "NO_VALUE_FOR_TYPE"
        log.append((step, kind, target, affected, n, left, status))
        if after is not current:
            current, stored = after, False
        n = left
    schema = ("step int, action_type string, target string, rows_affected long, before_count long, after_count long, "
              "execution_status string")
    return (current, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aside) if aside else None,
            spark.createDataFrame(log, schema))


def apply_actions(df: DataFrame, actions: Sequence[dict], keys: Sequence[str]) -> DataFrame:
    return run_actions(df, actions, keys)[0]


def action_audit(df: DataFrame, actions: Sequence[dict], keys: Sequence[str]) -> DataFrame:
    """Rows or cells affected by each action."""
    return run_actions(df, actions, keys)[2]


# --- verify -----------------------------------------------------------------------

def verify(before: DataFrame, after: DataFrame, rows_before: DataFrame, rows_after: DataFrame) -> DataFrame:
    """One row: PASS, PARTIAL_PASS or FAIL with the numbers behind it.

    Both findings frames must come from the same detectors with the same expected
    schema and reference.
    """
    n = F.count(F.lit(1))
    b = before.agg(n.alias("n")).scalar()
    sizes = rows_before.agg(n).scalar(), rows_after.agg(n).scalar()
    a = after.agg(n.alias("after_finding_count"),
                  F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("severe"))
    return (a.withColumn("before_finding_count", b)
            .withColumn("resolved_finding_count",
                        F.greatest(F.lit(0), F.expr("before_finding_count - after_finding_count")))
            .withColumn("original_row_count", sizes[0]).withColumn("remediated_row_count", sizes[1])
            .select(F.expr("""case when after_finding_count = 0 then 'PASS'
                                   when severe = 0 and after_finding_count < before_finding_count
                                        then 'PARTIAL_PASS'
                                   else 'FAIL' end as verdict"""),
                    "before_finding_count", "after_finding_count", "resolved_finding_count",
                    F.expr("""round(coalesce(try_divide(resolved_finding_count,
                              before_finding_count) * 100, 100.0), 2)
                              as anomaly_reduction_rate_pct"""),
                    "original_row_count", "remediated_row_count",
                    F.expr("remediated_row_count - original_row_count as row_delta")))
