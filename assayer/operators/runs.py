"""History of pipeline runs: state, leave-one-out baselines, findings, causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.expr import num

# fixed values
SIGMAS, MIN_DEVIATION, MIN_RUNS = 2.0, 0.05, 3
METRICS = (
    # order, metric, column, finding type, likely area
    (1, "Input Rows", "rows_input", "Input Volume Anomaly",
     "Source ingestion or upstream data availability"),
    (2, "Output Rows", "rows_output", "Output Volume Anomaly",
     "Transformation, filtering, aggregation, or loading stage"),
    (3, "Execution Duration (ms)", "duration_ms", "Execution Performance Anomaly",
     "Transformation, database query, resource utilization, or loading stage"),
    (4, "Output/Input Ratio", "output_ratio", "Output Conversion Ratio Anomaly",
     "Transformation, filtering, validation, or loading stage"),
)
VOLUME_STEPS = ((50, "CRITICAL"), (20, "HIGH"), (5, "MEDIUM"))
OTHER_STEPS = ((50, "HIGH"), (20, "MEDIUM"), (5, "LOW"))
RUN_CAUSES = {
    "Output Rows": (
        0.85,
        "Potential record loss during ETL transformation, filtering, aggregation, or loading.",
        "Transformation, filtering, aggregation, or loading"),
    "Output/Input Ratio": (
        0.90,
        "Unexpected filtering, validation rejection, transformation loss, or incomplete loading.",
        "Transformation, filtering, validation, or loading"),
}
GENERIC_CONFIDENCE = 0.50
LOSS_WORDS = ("record loss", "filtering", "loading")
LOSS_CAUSE = ("Potential record loss during ETL transformation, filtering, validation, or loading.")
LOSS_AREA = "Transformation, filtering, validation, or loading"
LIST_LIMIT = 50

_RUN_FIELDS = ("pipeline_id", "dataset_id", "started_at", "completed_at", "status",
               "rows_input", "rows_output", "duration_ms")


def fold_runs(log: DataFrame) -> DataFrame:
    """Latest state per run of an append-only log (run_id, seq, fields...).

    A null field in a later record leaves the earlier value; a missing duration
    follows from the two times.
    """
    latest = log.groupBy("run_id").agg(*[
        F.expr(f"max_by({f}, case when {f} is not null then seq end) as {f}") for f in _RUN_FIELDS])
    elapsed = F.expr("timestampdiff(MICROSECOND, started_at, completed_at) / 1000.0D")
    return latest.withColumn("duration_ms", F.coalesce("duration_ms", elapsed))


def measured_runs(runs: DataFrame) -> DataFrame:
    """Active successful runs with the output/input ratio."""
    live = runs.where(F.col("status") == "SUCCESS")
    if "is_active" in runs.columns:
        live = live.where("is_active")
    return live.withColumn("output_ratio", F.expr(
        "case when rows_input > 0 then rows_output / rows_input end"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Four rows per run: (run_id, pipeline_id, dataset_id, metric_order, metric, actual)."""
    rows = ", ".join(f"struct({o} as metric_order, '{m}' as metric, cast({c} as double) as actual)"
                     for o, m, c, _, _ in METRICS)
    return measured_runs(runs).select("run_id", "pipeline_id", "dataset_id", "started_at",
                                      F.expr(f"inline(array({rows}))"))


def run_baseline(runs: DataFrame, min_runs: int = MIN_RUNS) -> DataFrame:
    """Per run and metric the mean and 2-sigma bounds of all *other* runs of its scope.

    Scope: same pipeline, and same data set where the run names one.  Sums are
    built once per scope and the own value is taken out of them, so no run ever
    meets the others of a large pipeline:

        mean' = (sum - x) / (n - 1),  M2' = M2 - d^2 n / (n - 1),  d = x - mean

    The sum form keeps the mean of whole-number metrics exact; the centred form
    keeps the variance from cancelling.
    """
    metrics = run_metrics(runs)
    scopes = metrics.select("pipeline_id", "metric", "actual", F.expr(
        "explode(if(dataset_id is null, array(string(null)), array(string(null), dataset_id)))"
        " as scope_dataset"))
    sums = scopes.groupBy("pipeline_id", "scope_dataset", "metric").agg(
        F.count(F.lit(1)).alias("runs"), F.count("actual").alias("n"),
        F.avg("actual").alias("mean"), F.sum("actual").alias("sum"),
        (F.var_pop("actual") * F.count("actual")).alias("m2"))
    joined = metrics.alias("m").join(
        sums.alias("s"),
        (F.col("m.pipeline_id") == F.col("s.pipeline_id")) & (F.col("m.metric") == F.col("s.metric"))
        & F.col("m.dataset_id").eqNullSafe(F.col("s.scope_dataset")))
    x, n = F.col("actual"), F.col("n")
    others = n - F.when(x.isNotNull(), 1).otherwise(0)
    d = F.coalesce(x - F.col("mean"), F.lit(0.0))
    return (joined.select("m.*", "runs", "n", "mean", "sum", "m2")
            .where(F.col("runs") - 1 >= min_runs)
            .withColumn("n_other", others).where(F.col("n_other") > 0)
            .withColumn("average", (F.col("sum") - F.coalesce(x, F.lit(0.0))) / F.col("n_other"))
            .withColumn("std", F.sqrt(F.greatest(
                F.lit(0.0), F.when(x.isNull(), F.col("m2"))
                .otherwise(F.col("m2") - d * d * n / F.col("n_other"))) / F.col("n_other")))
            .withColumn("lower_bound", F.greatest(F.lit(0.0), F.col("average") - SIGMAS * F.col("std")))
            .withColumn("upper_bound", F.col("average") + SIGMAS * F.col("std"))
            .select("run_id", "pipeline_id", "dataset_id", "started_at", "metric_order", "metric",
                    "actual", "n_other", "average", "std", "lower_bound", "upper_bound"))


def metric_checks(baseline: DataFrame) -> DataFrame:
    """Outside the bounds and at least 5 % away from the mean."""
    deviation = (F.when(F.col("average") == 0, 0.0)
                 .otherwise(F.abs(F.col("actual") - F.col("average")) / F.abs("average")))
    outside = (F.col("actual") < F.col("lower_bound")) | (F.col("actual") > F.col("upper_bound"))
    b = (baseline.where(F.col("actual").isNotNull()).withColumn("deviation", deviation)
         .withColumn("is_outside", outside)
         .withColumn("is_anomaly", outside & (deviation >= MIN_DEVIATION)))
    pct = num(F.col("deviation") * 100, 2)
    explanation = (
        F.when(F.col("is_anomaly"), F.concat(
            "metric", F.lit(" is significantly outside the historical normal range. Actual value is "),
            num(F.col("actual"), 2), F.lit(", while the expected range is "),
            num(F.col("lower_bound"), 2), F.lit(" to "), num(F.col("upper_bound"), 2),
            F.lit(". The relative deviation is "), pct, F.lit("%.")))
        .when(F.col("is_outside"), F.concat(
            "metric", F.lit(" is slightly outside the historical range, but the deviation is only "),
            pct, F.lit("%, which is below the 5% anomaly threshold.")))
        .otherwise(F.concat("metric", F.lit(" is within the historical normal range."))))
    return b.withColumn("explanation", explanation)


def run_anomalies(checks: DataFrame) -> DataFrame:
    """One row per run: is it anomalous, the share of anomalous metrics, a summary.
    A run has four metrics, so the collected names are bounded."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("is_anomaly"), F.struct("metric_order", "metric")))),
        lambda s: s["metric"]), ", ")
    return (checks.groupBy("run_id", "pipeline_id", "dataset_id").agg(
                F.bool_or("is_anomaly").alias("is_anomaly"),
                F.avg(F.col("is_anomaly").cast("int")).alias("anomaly_score"),
                names.alias("_names"))
            .select("run_id", "pipeline_id", "dataset_id", "is_anomaly", "anomaly_score",
                    F.when(F.col("is_anomaly"), F.concat(F.lit("Anomaly detected in: "), "_names"))
                    .otherwise("ETL run is within the historical baseline.").alias("summary")))


def _steps(pct: Column, steps, otherwise: str) -> Column:
    out = F.when(pct >= steps[0][0], steps[0][1])
    for bound, label in steps[1:]:
        out = out.when(pct >= bound, label)
    return out.otherwise(otherwise)


def _lookup(column: int) -> Column:
    out = None
    for row in METRICS:
        cond, value = F.col("metric") == row[1], row[column]
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def run_findings(checks: DataFrame) -> DataFrame:
    pct = F.col("deviation") * 100
    severity = (F.when(F.col("metric").isin("Output Rows", "Output/Input Ratio"),
                       _steps(pct, VOLUME_STEPS, "LOW"))
                .otherwise(_steps(pct, OTHER_STEPS, "INFO")))
    kind = F.coalesce(_lookup(3), F.lit("ETL Metric Anomaly"))
    return (checks.where(F.col("is_anomaly") & (F.col("deviation") >= MIN_DEVIATION))
            .select("run_id", "pipeline_id", "started_at", "metric_order", "metric",
                    kind.alias("finding_type"), severity.alias("severity"),
                    F.col("actual").alias("actual_value"),
                    F.col("average").alias("expected_average"),
                    "lower_bound", "upper_bound", "deviation",
                    F.concat(F.lit("Actual value: "), num(F.col("actual"), 2),
                             F.lit(". Historical average: "), num(F.col("average"), 2),
                             F.lit(". Expected range: "), num(F.col("lower_bound"), 2),
                             F.lit(" to "), num(F.col("upper_bound"), 2),
                             F.lit(". Deviation from historical average: "), num(pct, 2),
                             F.lit("%.")).alias("evidence"),
                    F.coalesce(_lookup(4), F.lit("ETL pipeline")).alias("likely_area"),
                    F.concat(kind, F.lit(" detected. The "), "metric",
                             F.lit(" metric deviates significantly from historical behaviour."))
                    .alias("explanation")))


def replace_findings(stored: DataFrame, fresh: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings after the given runs were analysed again: theirs are replaced as a
    whole, so a run without new findings loses its old ones."""
    kept = stored.join(runs.select("run_id").distinct(), "run_id", "left_anti")
    return kept.unionByName(fresh)


def run_causes(findings: DataFrame) -> DataFrame:
    """Root-cause candidates per run; record-loss candidates are merged into one,
    placed first, with the highest confidence and all evidence in metric order.
    A run has at most four findings, so its evidence list is bounded."""
    dev = F.concat(num(F.col("deviation") * 100, 2), F.lit("%."))
    rows_text = F.array(
        F.concat(F.lit("Output rows were "), num(F.col("actual_value"), 0),
                 F.lit(", compared with a historical expected average of approximately "),
                 num(F.col("expected_average"), 0), F.lit(" rows.")),
        F.concat(F.lit("The expected output range was "), num(F.col("lower_bound"), 0),
                 F.lit(" to "), num(F.col("upper_bound"), 0), F.lit(" rows.")),
        F.concat(F.lit("Observed output deviation was "), dev))
    ratio_text = F.array(
        F.concat(F.lit("Observed output/input ratio was "), num(F.col("actual_value"), 4), F.lit(".")),
        F.concat(F.lit("Historical expected ratio was "), num(F.col("expected_average"), 4), F.lit(".")),
        F.concat(F.lit("The expected ratio range was "), num(F.col("lower_bound"), 4),
                 F.lit(" to "), num(F.col("upper_bound"), 4), F.lit(".")),
        F.concat(F.lit("Ratio deviation was "), dev))

    def pick(volume, ratio, other):
        return (F.when(F.col("metric") == "Output Rows", volume)
                .when(F.col("metric") == "Output/Input Ratio", ratio).otherwise(other))

    (c1, cause1, area1), (c2, cause2, area2) = RUN_CAUSES["Output Rows"], RUN_CAUSES["Output/Input Ratio"]
    cause = pick(F.lit(cause1), F.lit(cause2), F.concat(
        F.lit("Abnormal behaviour associated with "), "metric", F.lit(".")))
    single = findings.select(
        "run_id", "metric_order", cause.alias("cause"),
        pick(F.lit(c1), F.lit(c2), F.lit(GENERIC_CONFIDENCE)).alias("confidence"),
        pick(rows_text, ratio_text, F.array("evidence")).alias("evidence"),
        pick(F.lit(area1), F.lit(area2), F.col("likely_area")).alias("affected_area"))
    loss = F.lit(False)
    for word in LOSS_WORDS:
        loss = loss | F.lower("cause").contains(word)
    merged = (single.withColumn("is_loss", loss)
              .withColumn("slot", F.when(F.col("is_loss"), 0).otherwise(F.col("metric_order")))
              .groupBy("run_id", "slot").agg(
                  F.bool_or("is_loss").alias("is_loss"),
                  F.min("cause").alias("cause"), F.max("confidence").alias("confidence"),
                  F.min("affected_area").alias("affected_area"),
                  F.array_sort(F.collect_list(F.struct("metric_order", "evidence"))).alias("e")))
    return merged.select(
        "run_id", F.col("slot").alias("cause_order"),
        F.when(F.col("is_loss"), LOSS_CAUSE).otherwise(F.col("cause")).alias("cause"), "confidence",
        F.array_join(F.flatten(F.transform("e", lambda s: s["evidence"])), " ").alias("evidence"),
        F.when(F.col("is_loss"), LOSS_AREA).otherwise(F.col("affected_area")).alias("affected_area"))


def primary_causes(causes: DataFrame) -> DataFrame:
    """Highest confidence, the first candidate on ties."""
    best = F.struct("confidence", -F.col("cause_order"))
    return causes.groupBy("run_id").agg(
        F.max_by("cause", best).alias("primary_cause"),
        F.max("confidence").alias("overall_confidence"),
        F.count(F.lit(1)).alias("candidate_count"))


def list_runs(runs: DataFrame, pipeline_id: str | None = None, dataset_id: str | None = None,
              status: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """A page of runs, newest first."""
    for name, value in (("pipeline_id", pipeline_id), ("dataset_id", dataset_id), ("status", status)):
        if value is not None:
            runs = runs.where(F.col(name) == value)
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit)
