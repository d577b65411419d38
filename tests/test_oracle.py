"""Every cheap registered query against its SQL on the smallest tables.

The queries that run a whole audit share one code path; a few of them stand for
all here, and tools/check.py compares every one.
"""

import pytest

import __spark_entry__ as entry
import check

AUDITS = {
    "findings_by_severity", "findings_by_topic", "report_summary", "report_actions", "evidence_items",
    "evidence_status", "severity_distribution", "highest_severity", "audit_status", "finding_types",
    "inspection_summary", "canonical_audit", "audit_hash", "root_cause_candidates", "primary_cause",
    "top_causes", "alerts", "plan_policy", "validate_actions", "gate_actions"}


@pytest.fixture(scope="module")
def con(data):
    return check.connect(data)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - AUDITS))
def test_query_equals_sql(spark, con, data, name):
    assert check.compare(spark, con, data, name, entry.oracle_sql()[name]).startswith("ok")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
