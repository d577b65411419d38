"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("assayer")
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.driver.memory", memory)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.adaptive.enabled", "true")
            .getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: that of the ``scratch`` block in force, else the one
    the cluster names in ``spark.checkpoint.dir``.  A local session without it gets one of its own, kept here:
    the setting can't be changed while a session runs."""
    if _scratch:
        return _scratch[-1]
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getCheckpointDir())
    if configured:
        return configured
    if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="assayer-"))
    return _local[0]


_local: list[str] = []
_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession, folder: str | None = None):
    """A folder of its own for all intermediate tables of a block, removed at its end.

    ``folder`` is a place that all executors share; by default the session's.  Frames
    made inside read from it, so write the results that are to last before the block ends.
    """
    own = os.path.join(folder or shared_dir(spark), f"scratch-{uuid.uuid4().hex}")
    _scratch.append(own)
    try:
        yield own
    finally:
        _scratch.remove(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write once under the shared folder and read back.

    Cuts lineage and survives lost executors; unlike an RDD checkpoint the copy
    is columnar, so what follows still prunes columns and skips row groups.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
