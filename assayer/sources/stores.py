"""Stored tables: baselines, audit history, dataset registry, fingerprints.

Histories are append-only Parquet, partitioned by the low-cardinality
``dataset_path`` so that reading one data set prunes the rest.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expr import ident
from assayer.functions.signing import canonical_record, hmac_sha256
from assayer.operators.findings import FINDING_SCHEMA, audit_status
from assayer.operators.quality import quality_score
from assayer.session import written


FINDING_COLUMNS = ("finding_type", "column_name", "severity", "message", "affected_count", "affected_pct", "evidence",
                   "stage", "ordinal", "expected_type", "actual_type")
FINDING_TYPE = "array<struct<" + ", ".join(f"{c}: string" for c in FINDING_COLUMNS) + ", created_order: int>>"
PROOF_COLUMNS = ("method", "column_name", "status", "flagged_count")
PROOF_TYPE = "array<struct<method: string, column_name: string, status: string, flagged_count: bigint>>"


# --- fingerprint ---------------------------------------------------------------

def table_fingerprint(df: DataFrame) -> DataFrame:
    """Digest of a table's content, independent of row order and file layout.

    Row digests are cut into four 60-bit slices and summed, so the combination is
    a plain aggregate and copies count.  Slices have 19 digits and sums 38: room for
    10^19 rows.
    """
    cols = [f"unix_micros(cast({ident(f.name)} as timestamp)) as {ident(f.name)}"
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else ident(f.name) for f in df.schema.fields]
    digest = df.selectExpr(*cols).select(
        F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256).alias("h"))
    slices = [F.expr(f"coalesce(sum(cast(conv(substr(h, {1 + 15 * i}, 15), 16, 10) as decimal(28, 0))), 0)"
                     f" as s{i}") for i in range(4)]
    text = F.concat_ws(":", F.col("row_count").cast("string"),
                       *[F.col(f"s{i}").cast("string") for i in range(4)])
    return (digest.agg(F.count(F.lit(1)).alias("row_count"), *slices)
            .select("row_count", F.sha2(text, 256).alias("fingerprint")))


# --- merge rules -----------------------------------------------------------------

def upsert(stored: DataFrame, incoming: DataFrame, key: str = "dataset_path") -> DataFrame:
    """Stored rows with those of the incoming keys replaced as a whole."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def ensure(stored: DataFrame, incoming: DataFrame, key: str = "dataset_path") -> DataFrame:
    """Stored rows plus the incoming ones whose key is not stored yet."""
    return stored.unionByName(incoming.join(stored.select(key).distinct(), key, "left_anti"))


# --- tables on disk ----------------------------------------------------------------

class Store:
    """Tables under one root folder, each partitioned by dataset_path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def read(self, name: str, dataset_path: str | None = None) -> DataFrame | None:
        try:
            df = self.spark.read.parquet(self.path(name))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return df if dataset_path is None else df.where(F.col("dataset_path") == dataset_path)

    def append(self, name: str, df: DataFrame, dataset_path: str) -> None:
        (df.withColumn("dataset_path", F.lit(dataset_path)).write.mode("append")
         .partitionBy("dataset_path").parquet(self.path(name)))

    def replace(self, name: str, df: DataFrame, dataset_path: str) -> None:
        """Overwrite the partition of one data set, leave the others alone."""
        (df.withColumn("dataset_path", F.lit(dataset_path)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("dataset_path")
         .parquet(self.path(name)))

    # baselines: schema, reference rows and numeric summary of a data set

    def set_baseline(self, dataset_path: str, df: DataFrame) -> None:
        """The whole table is the reference: any part of it taken by key would drift for ever
        in every column that follows the key."""
        from assayer.operators.profile import numeric_summary
        from assayer.operators.schema import infer_schema
        rows = written(df, "reference")
        schema = infer_schema(rows)
        self.replace("baseline_schema", schema, dataset_path)
        self.replace(f"baseline_rows_{abs_hash(dataset_path)}", rows, dataset_path)
        self.replace("baseline_summary", numeric_summary(rows, schema), dataset_path)

    def get_baseline(self, dataset_path: str) -> tuple[DataFrame, DataFrame] | None:
        """(expected schema, reference rows), or None."""
        schema = self.read("baseline_schema", dataset_path)
        if schema is None or schema.isEmpty():
            return None
        rows = self.read(f"baseline_rows_{abs_hash(dataset_path)}", dataset_path)
        return schema.drop("dataset_path"), rows.drop("dataset_path")

    def ensure_baseline(self, dataset_path: str, df: DataFrame) -> bool:
        """True when a new baseline was stored."""
        if self.get_baseline(dataset_path) is not None:
            return False
        self.set_baseline(dataset_path, df)
        return True

    # inspections: one record each, with its findings and proofs nested, so that saving is one commit

    def save_inspection(self, dataset_path: str, audited: DataFrame, findings: DataFrame, created_at: str, *,
                        inspection_id: str | None = None, proofs: DataFrame | None = None,
                        secret: bytes | None = None) -> str:
        """Append one inspection of ``audited``; its id.

        The id defaults to a digest of path, time and findings, so a retry writes the same
        id again and is read once.  The record holds time, counts, digest and, with
        ``secret``, the keyed signature.  Findings of one audit are a few per column.
        """
        kept = written(findings, "findings")
        status = audit_status(kept)
        text = canonical_record(kept, dataset_path, audited.agg(F.count(F.lit(1))).scalar(), len(audited.columns),
                                status.select("status").scalar(), status.select("highest_severity").scalar())
        signed = text.select("record", F.sha2("record", 256).alias("audit_hash"),
                             (hmac_sha256(F.col("record"), secret) if secret else F.lit(None).cast("string"))
                             .alias("audit_hmac")).first()
        name = inspection_id or hashlib.sha256(f"{dataset_path}|{created_at}|{signed.audit_hash}".encode()).hexdigest()
        head = status.select(
            F.lit(name).alias("inspection_id"), "status", "highest_severity", "finding_count",
            audited.agg(F.count(F.lit(1))).scalar().alias("row_count"),
            F.lit(len(audited.columns)).cast("long").alias("column_count"),
            F.lit(created_at).cast("timestamp").alias("created_at"), F.lit(signed.audit_hash).alias("audit_hash"),
            F.lit(signed.audit_hmac).cast("string").alias("audit_hmac"))
        order = Window.orderBy("stage", "ordinal", F.col("column_name").asc_nulls_first())
        rows = kept.withColumn("created_order", F.row_number().over(order))
        nested = _nest(rows, "created_order").alias("findings")
        proof = (proofs.select(F.struct(*PROOF_COLUMNS).alias("p")).agg(F.array_sort(F.collect_list("p"))).scalar()
                 if proofs is not None else F.array()).cast(PROOF_TYPE)
        self.append("inspections", head.withColumn("findings", rows.agg(nested).scalar()).withColumn("proofs", proof),
                    dataset_path)
        return name

    def save_inspections(self, inspections: DataFrame, findings: DataFrame) -> None:
        """Append many inspections (see history) in one commit; findings(inspection_id, finding_type,
        severity, message, created_order)."""
        none = F.lit(None).cast("string")
        rows = findings.select("inspection_id", *[
            F.col(c) if c in findings.columns else none.alias(c) for c in FINDING_COLUMNS], "created_order")
        grouped = rows.groupBy("inspection_id").agg(_nest(rows, "created_order").alias("findings"))
        whole = inspections.join(grouped, "inspection_id", "left").select(
            "inspection_id", "dataset_path", "status", "highest_severity", F.col("finding_count").cast("long"),
            F.col("row_count").cast("long"), F.lit(None).cast("long").alias("column_count"),
            F.col("created_at").cast("timestamp"), none.alias("audit_hash"), none.alias("audit_hmac"),
            F.coalesce("findings", F.array().cast(FINDING_TYPE)).alias("findings"),
            F.array().cast(PROOF_TYPE).alias("proofs"))
        whole.write.mode("append").partitionBy("dataset_path").parquet(self.path("inspections"))

    def inspections(self) -> DataFrame | None:
        """One row per inspection without the nested parts; a record written twice counts once."""
        found = self._inspections()
        return found if found is None else found.drop("findings", "proofs")

    def _inspections(self) -> DataFrame | None:
        found = self.read("inspections")
        return found if found is None else found.dropDuplicates(["inspection_id"])

    def findings(self) -> DataFrame | None:
        """Findings of all inspections, with the id of theirs."""
        found = self._inspections()
        return found if found is None else found.select("inspection_id", F.inline("findings"))

    def audit_findings(self, inspection_id: str) -> DataFrame:
        """The findings of one inspection in the form in which an audit gives them."""
        rows = self.findings().where(F.col("inspection_id") == inspection_id)
        return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in (
            part.rsplit(" ", 1) for part in FINDING_SCHEMA.split(", "))])

    def proofs(self) -> DataFrame | None:
        """Proofs of all inspections, each with the finding that it supports, if there is one."""
        found = self._inspections()
        if found is None:
            return None
        kind = _proof_kind(F.col("p.method"))
        same = F.filter("findings", lambda f: (f["finding_type"] == kind) & f["column_name"].eqNullSafe(F.col("p.column_name")))
        return found.select("inspection_id", "findings", F.explode("proofs").alias("p")).select(
            "inspection_id", "p.*", F.get(same, F.lit(0))["severity"].alias("finding_severity"), (F.size(same) > 0).alias("is_linked"))


def _nest(rows: DataFrame, order: str):
    """Findings as a sorted array."""
    item = F.struct(order, *FINDING_COLUMNS)
    return F.transform(F.array_sort(F.collect_list(item)),
                       lambda f: F.struct(*[f[c].cast("string").alias(c) for c in FINDING_COLUMNS],
                                          f[order].cast("int").alias(order))).cast(FINDING_TYPE)


def abs_hash(text: str) -> str:
    """Folder-safe name of a dataset path (rows of different data sets differ in schema)."""
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _proof_kind(method):
    """Type of the finding that a method's proof supports."""
    return (F.when(method.isin("Z_SCORE", "IQR"), "NUMERICAL_OUTLIERS")
            .when(method == "ISOLATION_FOREST", "ML_ISOLATION_FOREST_ANOMALY").otherwise("DISTRIBUTION_DRIFT"))


def link_proofs(proofs: DataFrame, findings: DataFrame) -> DataFrame:
    """Each proof with the finding of the same method's type and column, if any.

    Whether the findings are broadcast is left to the engine: they may be a stored history.
    """
    kind = _proof_kind(F.col("method"))
    f = findings.select("finding_type", F.col("column_name").alias("f_column"),
                        F.col("severity").alias("finding_severity"))
    p = proofs.withColumn("finding_type", kind)
    return (p.join(f, (p["finding_type"] == f["finding_type"])
                   & p["column_name"].eqNullSafe(f["f_column"]), "left")
            .select("method", "column_name", "status", "flagged_count",
                    F.col("finding_severity"), F.col("finding_severity").isNotNull().alias("is_linked")))


def registry_row(df: DataFrame, name: str, path: str, fmt: str) -> DataFrame:
    """Registration record of a data set, computed on ingest."""
    return quality_score(df, "string").select(
        F.lit(name).alias("dataset_name"), F.lit("USER_UPLOAD").alias("dataset_type"),
        F.lit(path).alias("file_path"), F.lit(fmt).alias("file_format"),
        F.col("total_rows").alias("row_count"), F.col("total_columns").alias("column_count"),
        "quality_score", F.lit("Registered").alias("status"))
