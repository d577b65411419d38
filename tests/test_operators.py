"""Hand-made tables, invariants and brute-force comparisons."""

import hashlib
import hmac
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import expr as X
from assayer.functions.signing import hmac_sha256, verify_integrity
from assayer.operators import (causes, drift, faults, findings as fnd, forest, outliers, profile,
                               quality, quantiles, recovery, runs, schema)
from assayer.plans.audit import audit, recover
from assayer.sources import readers, stores
from assayer.streaming import streams


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def small(spark):
    rows = [("1", "C1", "10"), ("1", "C1", "10"), ("1", "C1", "10"), ("2", None, "20"), ("3", None, "30")]
    return spark.createDataFrame(rows, "order_id string, customer_id string, amount string")


def test_missing_and_duplicates(small):
    m = one(quality.missing_values(small))
    assert (m.column, m.missing_count, m.missing_percentage, m.severity) == ("customer_id", 2, 40.0, "HIGH")
    d = one(quality.duplicate_records(small))
    assert (d.duplicate_count, d.duplicate_percentage, d.severity) == (2, 40.0, "CRITICAL")


def test_missing_kinds(spark):
    df = spark.createDataFrame([(1, ""), (2, "  "), (3, "\t\n"), (4, " "), (5, None), (6, "x")],
                               "k int, c string")
    assert one(quality.missing_values(df)).missing_count == 5


def test_missing_order_follows_first_row(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b")], "k int, a string, b string")
    assert [r.column for r in quality.missing_values(df, "k").orderBy("position").collect()] == ["b", "a"]


def test_empty_dataset(spark, small):
    assert one(quality.empty_findings(small.limit(0))).finding_type == "EMPTY_DATASET"
    assert quality.empty_findings(small).count() == 0
    q = one(quality.quality_score(small.limit(0)))
    assert (q.quality_score, q.is_valid) == (100.0, True)


def test_number_rules(spark):
    texts = ["1", " 1.5 ", "1e3", "-2", ".5", "5.", "1d", "1.5f", "1_000", "nan", "inf", "-Infinity",
             "1e999", "", "abc", "\t7\n", None, "\u00a05\u2003", "1__0", "_1", "1_", "1_0.2_5e1_0", "\u0663"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.v for r in df.select("t", X.numeric(df, "t").alias("v")).collect()}
    want = {"1": 1.0, " 1.5 ": 1.5, "1e3": 1000.0, "-2": -2.0, ".5": 0.5, "5.": 5.0, "\t7\n": 7.0,
            "1_000": 1000.0, "\u00a05\u2003": 5.0, "1_0.2_5e1_0": 10.25e10}
    assert {k: v for k, v in got.items() if v is not None} == want


def test_infer_schema(spark):
    rows = [("1", "yes", "1", "1.5", "2024-1-5", "x", "", "5/12/2023", "nan"),
            ("2", "No", "-2", "2", "2024-01-05 10:00:00", "2024-13-45", None, "31/1/2024", "1")]
    df = spark.createDataFrame(rows, "order_id string, b string, i string, f string, d string, s string, "
                                     "e string, d2 string, n string")
    got = {r.column: r.logical_type for r in schema.infer_schema(df).collect()}
    assert got == {"order_id": "string", "b": "boolean", "i": "integer", "f": "float", "d": "datetime",
                   "s": "string", "e": "string", "d2": "datetime", "n": "float"}


def types(spark, **columns):
    return spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(columns.items())],
                                 "column string, ordinal int, logical_type string")


def test_schema_drift(spark):
    expected = types(spark, order_id="string", order_status="string", amount="float", n="int")
    actual = types(spark, order_id="varchar", order_status="integer", customer_email="string", n="BIGINT ")
    found = {r.column_name: (r.finding_type, r.severity)
             for r in schema.schema_findings(expected, actual).collect()}
    assert found == {"amount": ("COLUMN_REMOVED", "CRITICAL"), "customer_email": ("COLUMN_ADDED", "MEDIUM"),
                     "order_status": ("COLUMN_TYPE_CHANGED", "HIGH")}
    assert one(schema.schema_status(expected, expected)).status == "STABLE"


@pytest.mark.parametrize("n,parts", [(1, 1), (2, 1), (5, 3), (7, 2), (1000, 4), (60_000, 8)])
def test_exact_quantiles(spark, n, parts):
    rng = np.random.default_rng(n)
    # a third of the rows share one value
    x = np.where(rng.random(n) < 1 / 3, 7.0, rng.lognormal(3, 2, n))
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(parts)
    r = one(quantiles.exact_quantiles(df, ["x"]))
    assert np.allclose([r.q25, r.median, r.q75], np.percentile(x, [25, 50, 75]), rtol=1e-12)


def test_zscore_and_iqr(spark):
    rng = np.random.default_rng(42)
    x = [float(v) for v in rng.normal(10, 0.5, 50)] + [100.0]
    df = spark.createDataFrame(list(enumerate(x)), "k int, val double")
    z = outliers.zscore_rows(df, ["k"]).collect()
    assert [r._rid for r in z] == ["50"]
    assert z[0].z_score == pytest.approx(abs(100 - np.mean(x)) / np.std(x), abs=0.01)
    y = [10 + 0.25 * i for i in range(40)] + [150.0]
    df = spark.createDataFrame(list(enumerate(y)), "k int, amount double")
    r = one(outliers.iqr_rows(df, ["k"]))
    q1, q3 = np.percentile(y, [25, 75])
    assert (r._rid, r.direction) == ("40", "HIGH")
    assert r.upper_bound == pytest.approx(q3 + 1.5 * (q3 - q1), abs=1e-4)
    flat = spark.createDataFrame([(i, 1.0) for i in range(20)], "k int, v double")
    assert outliers.outlier_summary(flat.select("v")).count() == 0
    assert {r.status for r in outliers.method_proofs(outliers.outlier_measures(flat.select("v"))).collect()} \
        == {"NOT_APPLICABLE"}


def brute_ks(a, b):
    points = np.unique(np.concatenate([a, b]))
    return max(abs(np.mean(a <= p) - np.mean(b <= p)) for p in points)


@pytest.mark.parametrize("seed", range(4))
def test_ks_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    a = np.round(rng.normal(0, 1, 700), seed)        # few digits: ties
    b = np.where(rng.random(400) < 1 / 3, 0.5, np.round(rng.normal(0.3, 2, 400), seed))
    df = [spark.createDataFrame([(float(v),) for v in s], "x double").repartition(3) for s in (a, b)]
    for size in (1, 20, 100_000):  # parts cut again and again, a few times, not at all
        r = one(drift.ks_statistic(drift.paired_counts(*df), size))
        assert r.d == pytest.approx(brute_ks(a, b), abs=1e-12)
    assert one(drift.ks_statistic(drift.paired_counts(df[0], df[0]))).d == 0


def test_ks_decision_and_exact_p(spark):
    rng = np.random.default_rng(42)
    a, b = rng.normal(10, 1, 60), rng.normal(25, 1, 60)
    cur, ref = (spark.createDataFrame([(float(v),) for v in s], "metric double") for s in (b, a))
    r = one(drift.ks_test(drift.paired_counts(cur, ref), method="exact"))
    assert r.d > 0.5 and r.p < 0.001 and r.is_drift and r.severity == "HIGH" and r.p_method == "exact"
    # three against three: complete separation has probability 2 / C(6, 3)
    fn = drift.exact_p.func
    import pandas as pd
    assert fn(pd.Series([1.0]), pd.Series([3]), pd.Series([3]))[0] == pytest.approx(0.1)
    none = drift.ks_test(drift.paired_counts(cur.limit(5), ref))
    assert one(drift.drift_status(none, ref)).status == "INSUFFICIENT_DATA"
    assert one(drift.drift_status(none, ref.limit(5))).status == "NOT_EXECUTED"
    assert one(drift.drift_status(none, None)).status == "NOT_EXECUTED"


def test_path_share_equals_counting_cell_by_cell():
    def plain(d, n, m):
        limit, share = round(d * n * m), {(0, 0): 1.0}
        for i in range(n + 1):
            for j in range(m + 1):
                if i + j:
                    ok = abs(i * m - j * n) < limit
                    share[i, j] = (share.get((i - 1, j), 0) * i + share.get((i, j - 1), 0) * j) / (i + j) if ok else 0.0
        return 1.0 - share[n, m] if limit else 1.0

    rng = np.random.default_rng(7)
    for _ in range(60):
        n, m = (int(x) for x in rng.integers(1, 25, 2))
        d = round(rng.uniform(0, 1) * n * m) / (n * m)
        assert drift.path_share(d, n, m) == pytest.approx(plain(d, n, m), abs=1e-12)
    assert drift.path_share(0.02, 20_000, 20_000) == pytest.approx(2 * sum(
        (-1) ** (k - 1) * np.exp(-2 * k * k * 4) for k in range(1, 9)), rel=0.02)
    import pandas as pd
    with pytest.raises(ValueError):
        drift.exact_p.func(pd.Series([0.5]), pd.Series([100_000]), pd.Series([100_000]))


@pytest.fixture(scope="module")
def forest_table(spark):
    rng = np.random.default_rng(42)
    rows = [(i, float(rng.uniform(10, 20)), float(rng.uniform(50, 70))) for i in range(60)]
    return spark.createDataFrame(rows + [(60, 999.0, -500.0)], "k int, feature_a double, feature_b double")


def test_forest_flags_injected_row(forest_table):
    features = ["feature_a", "feature_b"]
    found = forest.detect(forest_table, ["k"], features=features, unique_keys=True)
    assert "60" in [r._rid for r in found.flagged.collect()]
    scores = {r._rid: r.score for r in forest.forest_scores(forest_table, ["k"], features=features,
                                                            unique_keys=True).collect()}
    assert min(scores, key=scores.get) == "60"
    again = {r._rid: r.score for r in forest.forest_scores(forest_table.repartition(7), ["k"],
                                                           features=features, unique_keys=True).collect()}
    assert scores == again
    assert one(forest.forest_findings(forest_table, ["k"], found)).finding_type == "ML_ISOLATION_FOREST_ANOMALY"


def test_forest_sample_is_bounded_under_one_hot_value(spark):
    df = spark.range(90_000).select("id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") * 0.5).alias("v"),
                                    (F.col("id") % 3).cast("double").alias("w"))
    df = df.withColumn("w", F.when(F.col("v") == 1.0, 5.0).otherwise(F.col("w")))
    s = forest._samples(df, ["v", "w"], [0.0, 0.0], 90_000, ["id"], False, 20, 256, 42)
    per_tree = s.groupBy("tree").agg(F.sum("w").alias("n"), F.sum(F.expr("if(f0 = 1.0, w, 0)")).alias("hot"))
    for r in per_tree.collect():
        assert 256 <= r.n < 600
        assert 0.2 < r.hot / r.n < 0.45


def test_deduplicate_and_quarantine(spark):
    rows = [(1, "ORD-001", "C1", 10.0), (2, "ORD-001 ", "C1", 10.0), (3, "ORD-002", None, 5.0), (4, "ORD-003", "C3", 7.0)]
    df = spark.createDataFrame(rows, "k int, order_id string, customer_id string, amount double")
    data = df.drop("k")
    dedup = recovery.deduplicate(data, "order_id")
    assert dedup.count() == 3
    assert recovery.deduplicate(dedup, "order_id").count() == 3
    kept, gone = recovery.quarantine_missing(dedup, "customer_id")
    assert (kept.count(), gone.count()) == (2, 1)


def test_recover_small_table(spark):
    rows = [("ORD-001", "C1", 10.0), ("ORD-001", "C1", 10.0), ("ORD-002", None, 5.0), ("ORD-003", "C3", 7.0)]
    df = spark.createDataFrame(rows, "order_id string, customer_id string, amount double")
    done = recover(df, keys=["order_id"], role="ADMIN")
    v = one(done["verdict"])
    assert (v.verdict, v.anomaly_reduction_rate_pct, v.remediated_row_count, v.row_delta) == ("PASS", 100.0, 2, -2)
    assert sorted(r.order_id for r in done["repaired"].collect()) == ["ORD-001", "ORD-003"]
    v = one(recover(df, keys=["order_id"], role="DATA_ENGINEER")["verdict"])
    assert v.verdict == "FAIL"


def test_impute_rules(spark):
    rows = [(1, 1, "a", "x"), (2, 2, "b", "x"), (3, 4, "b", None), (4, None, "a", None), (5, 9, None, "unknown")]
    df = spark.createDataFrame(rows, "k int, n int, s string, u string")
    got = {r.column: (r.strategy, r.impute_value) for r in recovery.impute_values(df, ["n", "s", "u"], "k").collect()}
    # median 3.0 of whole numbers; a and b tie, a was seen first
    assert got == {"n": ("MEDIAN", "3"), "s": ("MODE", "a"), "u": ("MODE", "x")}
    empty = spark.createDataFrame([(1, None)], "k int, s string")
    assert one(recovery.impute_values(empty, ["s"], "k")).impute_value == "UNKNOWN"
    filled = recovery.impute_from(df, "s", "k")
    assert quality.missing_values(filled.select("k", "s")).count() == 0


def test_text_keys_and_columns_without_values(spark):
    """Ties go to the text seen first in key order; a number column without a number stays null."""
    rows = [("b2", "x", None), ("a1", "y", None), ("c3", None, None), ("c3", None, None)]
    df = spark.createDataFrame(rows, "order_key string, note string, amount double")
    actions = [{"action_type": "DEDUPLICATE_ROWS", "target": "ALL_ROWS"},
               {"action_type": "IMPUTE_DEFAULT_VALUE", "target": "note"},
               {"action_type": "IMPUTE_DEFAULT_VALUE", "target": "amount"}]
    fixed, aside, log = recovery.run_actions(df, actions, ["order_key"])
    assert sorted(map(tuple, fixed.collect())) == [("a1", "y", None), ("b2", "x", None), ("c3", "y", None)]
    assert [tuple(r)[:3] for r in aside.collect()] == [("c3", None, None)]
    assert [(r.rows_affected, r.after_count, r.execution_status) for r in log.orderBy("step").collect()] == [
        (1, 3, "SUCCESS"), (1, 3, "SUCCESS"), (0, 3, "NO_VALUE_FOR_TYPE")]


def test_recover_keeps_what_it_sets_aside(spark, tmp_path):
    rows = [(f"ORD-{i}", f"C{i}", float(i % 7)) for i in range(40)] + [("ORD-1", "C1", 1.0), (None, "C50", 2.0)]
    df = spark.createDataFrame(rows, "order_id string, customer string, amount double")
    done = recover(df, keys=["order_id"], role="ADMIN", target=str(tmp_path))
    gone = spark.read.parquet(str(tmp_path / "quarantine"))
    assert {(r._action_type, r.customer) for r in gone.collect()} == {
        ("DEDUPLICATE_ROWS", "C1"), ("QUARANTINE_NULL_RECORDS", "C50")}
    assert spark.read.parquet(str(tmp_path / "repaired")).count() == 40 and done["log"].count() >= 2


def test_scratch_folder_is_removed(spark, tmp_path):
    from assayer.session import scratch, shared_dir, written
    with scratch(spark, str(tmp_path)) as own:
        assert shared_dir(spark) == own and written(spark.range(5)).count() == 5
        assert len(list(tmp_path.iterdir())) == 1
    assert not list(tmp_path.iterdir()) and shared_dir(spark) != own


def test_outlier_steps_stay_linear(spark):
    """The plan of a chain of outlier steps does not multiply."""
    df = spark.range(2000).selectExpr("id", *[f"cast(if(id = {i}, 1e6, id % 50) as double) as v{i}" for i in range(4)])
    acts = [{"action_type": "QUARANTINE_ML_OUTLIERS", "target": f"v{i}"} for i in range(4)]
    sizes = [recovery.apply_actions(df, acts[:n], ["id"])._jdf.queryExecution().optimizedPlan().toString().count("\n")
             for n in (1, 2, 4)]
    assert sizes[2] <= sizes[0] + 4 and recovery.apply_actions(df, acts, ["id"]).count() == 1996


def test_restore_and_accept(spark, small):
    assert dict(recovery.restore_column(small, "paid", "float").dtypes)["paid"] == "double"
    assert recovery.restore_column(small, "amount", "float").columns == small.columns


def test_verdicts(spark):
    def frame(*severities):
        return spark.createDataFrame([(s,) for s in severities], "severity string")

    rows = spark.range(3)
    def verdict(b, a):
        return one(recovery.verify(b, a, rows, rows)).verdict
    assert verdict(frame("HIGH"), frame()) == "PASS"
    assert verdict(frame("HIGH", "LOW"), frame("LOW")) == "PARTIAL_PASS"
    assert verdict(frame("HIGH", "LOW"), frame("HIGH")) == "FAIL"
    assert verdict(frame("LOW"), frame("LOW")) == "FAIL"


def brute_runs(records):
    out = {}
    for r in records:
        others = [o["rows_input"] for o in records if o["run_id"] != r["run_id"]
                  and o["pipeline_id"] == r["pipeline_id"]
                  and (r["dataset_id"] is None or o["dataset_id"] == r["dataset_id"])]
        if len(others) >= 3:
            m, s = float(np.mean(others)), float(np.std(others))
            out[r["run_id"]] = (m, max(0.0, m - 2 * s), m + 2 * s)
    return out


def test_leave_one_out_equals_brute_force(spark):
    rng = random.Random(1)
    records = [dict(run_id=f"r{i}", pipeline_id="p" if i % 3 else "q", dataset_id=rng.choice([None, "a", "b"]),
                    rows_input=rng.randrange(1_000_000), rows_output=5, duration_ms=1.0, status="SUCCESS")
               for i in range(40)]
    df = spark.createDataFrame(records, "run_id string, pipeline_id string, dataset_id string, rows_input long, "
                                        "rows_output long, duration_ms double, status string")
    df = df.withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.run_id: (r.average, r.lower_bound, r.upper_bound)
           for r in runs.run_baseline(df).where("metric = 'Input Rows'").collect()}
    want = brute_runs(records)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)


def test_fold_runs_keeps_earlier_values(spark):
    log = spark.sql("""select 'a' run_id, 1 seq, 'p' pipeline_id, 'd' dataset_id, timestamp'2024-01-01 00:00:00' started_at,
        cast(null as timestamp) completed_at, 'RUNNING' status, 5L rows_input, cast(null as long) rows_output,
        cast(null as double) duration_ms union all
        select 'a', 2, null, null, null, timestamp'2024-01-01 00:00:02', 'SUCCESS', null, 4L, null""")
    r = one(runs.fold_runs(log))
    assert (r.pipeline_id, r.status, r.rows_input, r.rows_output, r.duration_ms) == ("p", "SUCCESS", 5, 4, 2000.0)


def test_hmac_and_integrity(spark):
    df = spark.createDataFrame([("héllo",)], "t string")
    got = one(df.select(hmac_sha256(F.col("t"), b"k" * 100).alias("h"))).h
    assert got == hmac.new(b"k" * 100, "héllo".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        hmac_sha256(F.col("t"), b"")
    stored = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None)], "inspection_id string, audit_hash string")
    fresh = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "inspection_id string, audit_hash string")
    assert {r.inspection_id: r.integrity for r in verify_integrity(stored, fresh).collect()} == {
        "a": "VALID", "b": "TAMPERED", "c": "LEGACY_UNSIGNED"}


@pytest.mark.parametrize("mode", ["CLEAN", "MISSING_VALUES", "DUPLICATES", "SCHEMA_DRIFT", "ML_OUTLIERS"])
def test_fault_modes(spark, data, mode):
    o = spark.read.parquet(f"{data}/lineitem.parquet").dropDuplicates()
    df, expected, seen = o, schema.infer_schema(o), None
    if mode == "MISSING_VALUES":
        df, seen = faults.inject_missing(o, "l_partkey", "l_orderkey"), "MISSING_VALUES"
    if mode == "DUPLICATES":
        df, seen = faults.inject_duplicates(o, F.col("l_orderkey") < 25), "DUPLICATE_RECORDS"
    if mode == "SCHEMA_DRIFT":
        df, seen = faults.inject_schema_drift(o), "COLUMN_REMOVED"
    if mode == "ML_OUTLIERS":
        df, seen = faults.inject_outliers(o, "l_orderkey", 5, "l_quantity"), "NUMERICAL_OUTLIERS"
    types_found = {r.finding_type for r in audit(df, order_key="l_orderkey", expected=expected).collect()}
    assert types_found - {"DUPLICATE_RECORDS"} == ({seen} if seen and mode != "DUPLICATES" else set())
    if mode == "DUPLICATES":
        assert types_found == {"DUPLICATE_RECORDS"}


def test_numbering_is_stable_under_repartition(spark, small):
    def ids(df):
        f = fnd.union_findings([quality.missing_findings(df, "order_id"), quality.duplicate_findings(df)])
        return sorted((r.evidence_id, r.finding_type) for r in fnd.evidence_items(f).collect())
    assert ids(small) == ids(small.repartition(5)) == [("E1", "MISSING_VALUES"), ("E2", "DUPLICATE_RECORDS")]


def test_readers(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes("﻿order_id,note,amount\r\n1,\"line one\nline \"\"two\"\"\",5\r\n2,\"\",\r\n".encode())
    rows = readers.read_dataset(spark, str(p), multiline=True).collect()
    assert rows[0].order_id == "1" and rows[0].note == 'line one\nline "two"' and rows[1].note == ""
    for name, body in (("a.json", [{"x": 1}, {"x": 2}]), ("b.json", {"data": [{"x": 1}, {"x": 2}]})):
        (tmp_path / name).write_text(json.dumps(body, indent=1))
        assert sorted(r.x for r in readers.read_dataset(spark, str(tmp_path / name), multiline=True).collect()) == [1, 2]
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "x.xls")
    with pytest.raises(ValueError):
        readers.read_dataset(spark, str(p))
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string").toDF(" a ", " ")
    clean = readers.drop_blank_rows(readers.normalised_headers(df))
    assert clean.columns == ["a", "column_2"] and clean.count() == 1


def test_fingerprint_ignores_order_and_counts_copies(spark, small):
    a = one(stores.table_fingerprint(small))
    assert a == one(stores.table_fingerprint(small.repartition(4)))
    assert a.fingerprint != one(stores.table_fingerprint(small.dropDuplicates())).fingerprint


def test_store(spark, tmp_path, small):
    store = stores.Store(spark, str(tmp_path))
    assert store.get_baseline("a") is None
    assert store.ensure_baseline("a", small) is True
    assert store.ensure_baseline("a", small.limit(1)) is False
    store.set_baseline("b", small.select("order_id"))
    store.set_baseline("a", small.limit(2).select("order_id", "amount"))
    s, sample = store.get_baseline("a")
    assert {r.column for r in s.collect()} == {"order_id", "amount"} and sample.count() == 2
    assert {r.column for r in store.get_baseline("b")[0].collect()} == {"order_id"}
    found = quality.missing_findings(small)
    for _ in range(2):
        name = store.save_inspection("a", small, found, "2024-01-01 00:00:00", secret=b"k")
    other = store.save_inspection("a", small, found, "2024-01-02 00:00:00",
                                  proofs=spark.createDataFrame([("Z_SCORE", "amount", "HEALTHY", 0)], stores.PROOF_TYPE[13:-2].replace(":", "")))
    assert {r.inspection_id for r in store.inspections().collect()} == {name, other}
    assert store.findings().count() == 2 * found.count() and one(store.proofs()).is_linked is False
    assert {(r.row_count, r.column_count) for r in store.inspections().collect()} == {(small.count(), len(small.columns))}
    assert [r.audit_hmac is not None for r in store.inspections().orderBy("created_at").collect()] == [True, False]


def test_stream_audit_equals_batch(spark, data):
    events = streams.stream_table(spark, data, "events.parquet")

    def check(df):
        return quality.missing_findings(faults.inject_missing(df, "user_id", "event_id"), "event_id")

    got = one(streams.audited_stream(events, check))
    want = one(check(spark.read.parquet(f"{data}/events.parquet")))
    assert (got.column_name, got.affected_count) == (want.column_name, want.affected_count)


def test_hot_duplicate_group_is_combined_before_the_shuffle(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a"))
    r = one(quality.duplicate_records(df))
    assert r.duplicate_count == 9_999
    assert recovery.deduplicate(df, "a").count() == 20_001


def test_unauthorised_requests(spark):
    cands = spark.createDataFrame([("ACT-001", "DEDUPLICATE_ROWS", "ALL_ROWS", "LOW", "POLICY_APPROVED")],
                                  "action_id string, action_type string, target string, risk_level string, "
                                  "policy_status string")
    asked = spark.createDataFrame([("1", "ACT-001", "DEDUPLICATE_ROWS", "ALL_ROWS"), ("2", None, "DEDUPLICATE_ROWS", "ALL_ROWS"),
                                   ("3", "ACT-001", "DROP", "ALL_ROWS"), ("4", "ACT-9", "X", "y")],
                                  "request_id string, action_id string, action_type string, target string")
    assert {r.request_id: r.validation for r in recovery.validate_actions(asked, cands).collect()} == {
        "1": "AUTHORIZED", "2": "AUTHORIZED", "3": "TYPE_MISMATCH", "4": "NOT_AUTHORIZED"}


def test_forest_draws_equal_rows_in_proportion(spark):
    """A row that is a third of the table is about a third of every tree's sample."""
    from assayer.operators.forest import _samples
    df = spark.range(3000).selectExpr("if(id < 1000, -1, id) as k", "double(if(id < 1000, -1, id)) as x")
    drawn = _samples(df, ["x"], [0.0], 3000, ["k"], False, 10, 32, 42).groupBy("tree").agg(
        F.sum("w").alias("n"), F.sum(F.expr("if(f0 = -1, w, 0)")).alias("same")).collect()
    assert len(drawn) == 10
    assert all(0.1 < r["same"] / r["n"] < 0.6 for r in drawn)


def test_row_ids_are_one_to_one(spark):
    rows = [(None, "x"), ("x", None), ("a|b", "c"), ("a", "b|c"), ("", "x"), ("\\N", "x"), ("a\\", "|b"), ("a\\|", "b")]
    df = spark.createDataFrame(rows, "k string, l string")
    ids = {tuple(r)[:2]: r._rid for r in df.withColumn("_rid", X.row_id(["k", "l"])).collect()}
    assert len(set(ids.values())) == len(rows) and one(spark.range(1).select(X.row_id(["id", "id"]).alias("r"))).r == "0|0"
    flagged = df.where("k IS NULL OR k = 'a|b'").select(X.row_id(["k", "l"]).alias("_rid"))
    kept, gone = recovery.quarantine_rows(df, flagged, ["k", "l"])
    assert {tuple(r) for r in gone.collect()} == {(None, "x"), ("a|b", "c")} and kept.count() == len(rows) - 2


def test_removed_copies_are_the_rows_that_were_there(spark):
    rows = [("ORD 1", 1), ("ORD 1 ", 1), ("ORD 1 ", 1), ("ORD 2", 1), ("ORD 3", 1), ("ORD 3", 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    kept, gone = recovery.split_duplicates(df, ["k"])
    assert sorted(map(tuple, kept.collect())) == [("ORD 1", 1), ("ORD 2", 1), ("ORD 3", 1)]
    assert sorted(map(tuple, gone.collect())) == [("ORD 1 ", 1), ("ORD 1 ", 1), ("ORD 3", 1)]


def test_session_without_a_folder():
    """A local session that names no shared folder gets one, and keeps it."""
    from assayer import session

    class Plain:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "local[2]"
            getConf = staticmethod(lambda: Plain.conf)
            getCheckpointDir = staticmethod(lambda: None)
    own = session.shared_dir(Plain)
    assert own == session.shared_dir(Plain)
    Plain.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        session.shared_dir(Plain)
