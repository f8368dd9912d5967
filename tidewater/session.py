"""The Spark session this engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_spark(name: str = "tidewater", **more: str) -> SparkSession:
    """A session with SETTINGS and any other settings, dots of which are written as two underscores."""
    builder = SparkSession.builder.appName(name)
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    for k, v in more.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def scratch_folder(spark, name: str) -> str:
    """A new folder for intermediate files, below spark.checkpoint.dir; a local one only where that is unset in local mode."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewater-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows read from files for a task of a shuffle that holds its rows in memory.
TASK_ROWS = 250_000


def file_rows(df) -> int:
    """Rows of the files that df reads, a file being counted as often as it is read; Parquet tells them by its footers."""
    plan, session = df._jdf.queryExecution().optimizedPlan(), df.sparkSession
    leaves = plan.collectLeaves() if not df.isStreaming else None
    files = [x for x in map(leaves.apply, range(leaves.size())) if x.nodeName().startswith("LogicalRelation") or "FileScan" in x.simpleString(9)] if leaves else []
    return sum(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, x).count() for x in files)


def spread(df, *keys):
    """df shuffled by keys into tasks in proportion to the rows that it reads; few rows are left to the planner."""
    n = min(4000, file_rows(df) // TASK_ROWS)
    return df.repartition(n, *keys) if n > 1 else df
