"""The audit that remembers, against one audit of the whole table."""

import pytest
from pyspark.sql import functions as F

from assayer.operators.quality import duplicate_findings, missing_findings
from assayer.operators.quantiles import column_moments
from assayer.streaming.memory import FANOUT, AuditMemory, live_parts, remembered


def rows(spark, items):
    return spark.createDataFrame(items, "id long, name string, v double")


def texts(df):
    return sorted((r.finding_type, r.column_name or "", r.message, r.evidence) for r in df.collect())


def whole(df):
    return texts(missing_findings(df, "id").unionByName(duplicate_findings(df)))


def test_parts_follow_from_the_number_of_batches():
    assert live_parts(0) == []
    assert live_parts(7) == [(0, i) for i in range(7)]
    assert live_parts(8) == [(1, 0)]
    assert live_parts(FANOUT * FANOUT + 8 + 2) == [(0, 72), (0, 73), (1, 8), (2, 0)]


def test_batches_add_up_over_a_merge(spark, tmp_path):
    batches = [[(10 * b + i, None if i == b % 4 else f"n{i}", None if b == 3 else 1e9 + b + i / 4) for i in range(4)]
               for b in range(10)]
    batches[9].append(batches[0][1])   # a copy in the last batch of a row of the first
    batches[5] = []                    # an empty batch
    memory = AuditMemory(spark, str(tmp_path / "m"), "id", ["v"])
    for n, items in enumerate(batches):
        memory.add(rows(spark, items), n)
        if n in (0, 7):                # a batch that is run again counts once, the merge included
            memory.add(rows(spark, items), n)
    table = rows(spark, [r for b in batches for r in b])
    assert texts(memory.findings(10)) == whole(table)
    assert "Detected 1 duplicate record(s)." in [t[2] for t in whole(table)]
    got, want = memory.profile(10).first(), column_moments(table, ["v"]).first()
    assert got.n == want.n
    assert got.mean == pytest.approx(want.mean, abs=1e-3) and got.std == pytest.approx(want["std"], abs=1e-3)
    before = texts(memory.findings(10))
    memory.vacuum(10)
    assert texts(memory.findings(10)) == before
    with pytest.raises(ValueError):
        memory.findings(0)


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "m")
    first = rows(spark, [(i, None if i % 3 == 0 else "a", float(i)) for i in range(12)])
    first.repartition(3).write.parquet(folder)

    def arriving():
        return spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    memory, n = remembered(arriving(), "id", root)
    assert n == 3 and texts(memory.findings(n)) == whole(first)
    first.where("id < 4").coalesce(1).write.mode("append").parquet(folder)
    memory, n = remembered(arriving(), "id", root)
    both = first.union(first.where("id < 4"))
    assert n == 4 and texts(memory.findings(n)) == whole(both)
    memory, again = remembered(arriving(), "id", root)
    assert again == n and memory.state("rows", n).agg(F.sum("copies")).first()[0] == 16
