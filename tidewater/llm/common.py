"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run of characters other than space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"

#: A key that holds at least 1/HEAVY_SHARE of the rows is heavy, so there are at most HEAVY_SHARE of them.
HEAVY_SHARE = 4096

#: Lookup tables of at most this many narrow rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            master = sc.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tidewater-")
        sc.setCheckpointDir(base)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into a table in the shared folder and reads it back.

    That cuts the lineage, survives lost executors, and gives the planner true sizes. (A checkpoint
    keeps the size estimates of what it replaces; joins multiply them, so a loop of joins soon has
    estimates of millions of digits, which fill the driver.) Tables go when the Python process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    """Deletes a table, if the session still lives."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the bytes of an Arrow batch, of which a task holds several in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files, broadcasts and checkpoints that nothing refers to any more.

    Spark learns what is dead from the driver's garbage collection, which it asks for every half
    hour only; a loop of many small jobs would pile up files and driver memory until then.
    """
    spark.sparkContext._jvm.System.gc()


def frugal(run):
    """run, a function of Arrow batches, which gives what it has freed back to the system when it ends.

    A Python worker serves task after task; what its allocators keep for later adds up to much more
    than any task needs, beside an executor that has grown meanwhile.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", rows: int | None = None, salts: int = 64) -> DataFrame:
    """Joins left with a table that has one row a key (null keys match null keys).

    A right side of at most BROADCAST_ROWS rows is broadcast. A larger one is dealt by key and salt:
    each left row takes a salt from its content, right rows are repeated for every salt, so no key
    lands in one task.
    """
    rows = right.count() if rows is None else rows
    named = [f"__r_{k}" for k in keys]
    right = right.withColumnsRenamed(dict(zip(keys, named, strict=True)))
    match = [left[k].eqNullSafe(right[n]) for k, n in zip(keys, named, strict=True)]
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), match, how).drop(*named)
    left = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    right = right.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    match = [left[k].eqNullSafe(right[n]) for k, n in zip(keys, named, strict=True)]
    return left.join(right, [*match, left["__salt"] == right["__rsalt"]], how).drop(*named, "__salt", "__rsalt")


def skew_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """Left or inner join of left with a table of one row a key that knows the key's rows in left.

    Keys with at least total / HEAVY_SHARE rows, of which there are at most HEAVY_SHARE, are
    broadcast; the rest have too few rows each to make a hot task and go through the shuffle. Rows
    that have met their heavy key pass that shuffle too, dealt by a salt from their content, so
    left is computed once. Null keys match nothing.
    """
    least = max(2, total // HEAVY_SHARE)
    values = [c for c in right.columns if c != key]
    heavy = right.where(F.col(count) >= least).select(F.col(key).alias("__hk"), *(F.col(c).alias(f"__h_{c}") for c in values))
    light = right.where(F.col(count) < least).select(F.col(key).alias("__lk"), *(F.col(c).alias(f"__l_{c}") for c in values), F.lit(0).alias("__ls"))
    rows = left.join(F.broadcast(heavy), left[key] == heavy["__hk"], "left")
    apart = F.col("__hk").isNotNull() | F.col(key).isNull()
    rows = rows.withColumn("__s", F.when(apart, 1 + F.pmod(F.xxhash64(*left.columns), F.lit(HEAVY_SHARE))).otherwise(0).cast("int"))
    rows = rows.join(light, (rows[key].eqNullSafe(light["__lk"])) & (rows["__s"] == light["__ls"]), "left")
    if how == "inner":
        rows = rows.where(F.col("__hk").isNotNull() | F.col("__lk").isNotNull())
    return rows.select(*left.columns, *(F.coalesce(f"__h_{c}", f"__l_{c}").alias(c) for c in values))
