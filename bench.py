"""Headline timings: one JSON line.

    BENCH_SF_DIR   folder of tables   (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores        (default 8)

Every query is timed once, after one untimed run of a small query that starts the
session.  Results are consumed in full by the no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from assayer.plans.registry import QUERIES
from assayer.session import local_session
from assayer.sources.readers import SCAN_PARTS

HEADLINE = ("missing_values", "duplicate_records", "profile_numeric", "profile_categorical",
            "outlier_summary", "drift_lineitem", "iforest_scores", "remediate_dedupe", "run_findings",
            "audit_findings")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    spark.conf.set(SCAN_PARTS, os.environ.get("BENCH_CPUS", "8"))  # the tables are one split each
    spark.read.parquet(os.path.join(folder, "lineitem.parquet")).groupBy("l_returnflag").avg("l_quantity").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(os.path.join(folder, "lineitem.parquet")).count()
    print(json.dumps({
        "metric": "audit suite, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "lineitem_rows": rows,
        "audit_rows_per_sec": round(rows / times["audit_findings"], 1)}))


if __name__ == "__main__":
    main()
