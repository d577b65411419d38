"""Whole audits and whole repairs, composed from the operators."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.expr import recovery_identifier
from assayer.operators.drift import drift_findings
from assayer.operators.causes import recommendations, root_cause_candidates, root_cause_patterns
from assayer.operators.findings import evidence_items, union_findings
from assayer.operators.forest import ForestModel, forest_findings
from assayer.operators.outliers import outlier_findings
from assayer.operators.quality import duplicate_findings, empty_findings, missing_findings
from assayer.operators.recovery import (gate_actions, impute_values, propose_actions, run_actions,
                                        verify)
from assayer.operators.schema import accept_columns, infer_schema, schema_findings
from assayer.session import written


def audit(df: DataFrame, *, order_key: str, expected: DataFrame | None = None,
          reference: DataFrame | None = None, forest_keys: Sequence[str] | None = None,
          unique_keys: bool = False, forest_model: ForestModel | None = None, drift_rule: str = "none",
          extra_identifiers: Iterable[str] = ()) -> DataFrame:
    """All findings of a table, one frame.  Lazy, except for the forest, which
    ``forest_keys`` asks for: it is fitted (unless given as ``forest_model``) and scores every row."""
    parts = [empty_findings(df), missing_findings(df, order_key), duplicate_findings(df)]
    if expected is not None:
        parts.append(schema_findings(expected, infer_schema(df)))
    parts.append(outlier_findings(df, extra_identifiers))
    if forest_keys:
        parts.append(forest_findings(df, forest_keys, model=forest_model, unique_keys=unique_keys,
                                     extra_identifiers=extra_identifiers))
    if reference is not None:
        parts.append(drift_findings(df, reference, drift_rule, extra_identifiers))
    return union_findings(parts)


def plan_recovery(df: DataFrame, findings: DataFrame, order_key: str) -> DataFrame:
    """Actions with the values to impute, computed on the audited table."""
    fillable = [c for c in df.columns if not recovery_identifier(c)]
    values = impute_values(df, fillable, order_key) if fillable else None
    return propose_actions(findings, values)


def dossier(findings: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(section, position, item, subject, text): evidence, causes, recommendations and actions
    that follow from the findings of one audit, such as a stored one."""
    causes = root_cause_candidates(findings).unionByName(
        root_cause_patterns(findings), allowMissingColumns=True)
    recs = recommendations(findings).withColumn("n", F.substring("rec_id", 5, 9).cast("int"))
    actions = propose_actions(findings, values)

    def part(name, rows, position, item, subject, text):
        return rows.select(F.lit(name).alias("section"), position.cast("int").alias("position"), item.alias("item"),
                           subject.alias("subject"), text.alias("text"))

    return (part("evidence", evidence_items(findings), F.col("position"), F.col("evidence_id"), F.col("finding_type"),
                 F.col("message"))
            .unionByName(part("cause", causes, F.col("cause_order"), F.col("level"), F.col("cause"), F.col("evidence")))
            .unionByName(part("recommendation", recs, F.col("n"), F.col("rec_id"), F.col("target_column"), F.col("title")))
            .unionByName(part("action", actions, F.col("position"), F.col("action_id"), F.col("target"),
                              F.col("estimated_impact"))))


def recover(df: DataFrame, *, keys: Sequence[str], role: str = "ADMIN",
            expected: DataFrame | None = None, reference: DataFrame | None = None,
            target: str | None = None, **options) -> dict[str, DataFrame | None]:
    """Audit, repair what the role may repair, audit again with the same detectors.

    The findings and the plan are small and written once; the repaired table is
    written before it is audited, so the second audit does not run the repairs
    again.  Only the plan (one row per finding) comes to the driver.  Accepted
    columns join the expected schema of the second audit.  ``quarantine`` has the
    rows set aside (None if no action sets rows aside), ``log`` a row per action.
    With ``target`` the repaired table and the quarantine are kept there, in
    folders of these names.
    """
    order_key = keys[0]
    check = dict(order_key=order_key, expected=expected, reference=reference, **options)
    before = written(audit(df, **check), "findings")
    plan = written(gate_actions(plan_recovery(df, before, order_key), role), "plan")
    rows = [r.asDict() for r in plan.where(F.col("execution_status") == "AUTHORIZED").orderBy("position").collect()]
    repaired, aside, log = run_actions(df, rows, keys, options.get("forest_model"))
    if target:
        repaired.write.parquet(os.path.join(target, "repaired"))
        repaired = df.sparkSession.read.parquet(os.path.join(target, "repaired"))
        if aside is not None:
            aside.write.parquet(os.path.join(target, "quarantine"))
            aside = df.sparkSession.read.parquet(os.path.join(target, "quarantine"))
    else:
        repaired = written(repaired, "repaired")
    accepted = [r["target"] for r in rows if r["action_type"] == "ACCEPT_NEW_COLUMN"]
    if expected is not None and accepted:
        check["expected"] = accept_columns(expected, infer_schema(repaired).where(F.col("column").isin(accepted)))
    after = written(audit(repaired, **check), "findings")
    return {"before": before, "plan": plan, "repaired": repaired, "quarantine": aside, "log": log, "after": after,
            "verdict": verify(before, after, df, repaired)}
