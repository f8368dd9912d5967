"""Streams: a source, a transform of tables, and a sink, run until what is there has been read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_folder


def run_stream(source: DataFrame, transform: Callable[[DataFrame], DataFrame], checkpoint: str | None = None) -> DataFrame:
    """Runs a transform over all that the source has and returns the result as a table, kept in files."""
    spark = source.sparkSession
    out, path = transform(source), scratch_folder(spark, "stream")
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint or f"{path}-checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def to_sink(source: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, every: str = "1 second"):
    """Runs a transform batch by batch and gives each result to sink(table, batch number); returns the query.

    transform sees each batch alone, so order-dependent functions start anew in each.
    """
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda d, n: sink(transform(d), n))
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": every})).start()


def buckets(source: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], late: str = "0 seconds") -> DataFrame:
    """A row for each time bucket and group; rows later than `late` are dropped."""
    rows = source.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, width).alias("__w"), *keys).agg(*aggregates)
    return out.select(F.col("__w.start").cast("timestamp_ntz").alias(time), *keys, *(c for c in out.columns if c != "__w" and c not in keys))


def bucket_stream(source: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], late: str = "0 seconds", checkpoint: str | None = None, every: str | None = None, timeout: float | None = None) -> DataFrame:
    """buckets() over all that the source has, the last one among them.

    Every batch gives out the buckets that it changed, open ones too, and the newest state of each
    counts. With `every` batches follow the clock, so a bucket is given out that soon after its rows
    came, whether or not later rows do; `timeout` ends such a stream after that many seconds.
    """
    spark = source.sparkSession
    path = scratch_folder(spark, "buckets")
    out = buckets(source, time, width, keys, aggregates, late)

    def keep(d: DataFrame, n: int) -> None:
        # a batch that is run again replaces what it had written
        d.write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = out.writeStream.outputMode("update").option("checkpointLocation", checkpoint or f"{path}-checkpoint").foreachBatch(keep)
    query = writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
    if not query.awaitTermination(timeout) if timeout is not None else query.awaitTermination():
        query.stop()
    rows = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    newest = F.row_number().over(W.partitionBy(time, *keys).orderBy(F.desc("batch")))
    return rows.withColumn("__r", newest).where("__r = 1").select(*out.columns)


def stream(source: DataFrame, transform: Callable[[DataFrame], DataFrame], time: str | None = None, late: str = "0 seconds") -> tuple[str, DataFrame]:
    """Runs a transform of a stream by its kind, which its plan shows: ("time_bucket" or "per_row", result).

    A transform that aggregates is of time buckets and needs the time column; others work by row.
    """
    timed = source.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if time else source
    plan = transform(timed)._jdf.queryExecution().analyzed().toString()
    if "Aggregate [" not in plan:
        return "per_row", run_stream(source, transform)
    if time is None:
        raise ValueError("a stream of time buckets needs its time column")
    return "time_bucket", run_stream(timed, transform)


def sliding_buckets(source: DataFrame, time: str, width: str, step: str, aggregates: list[Column], late: str = "0 seconds") -> DataFrame:
    """Overlapping buckets of a width that begin every step."""
    rows = source.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, width, step).alias("__w")).agg(*aggregates)
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *(c for c in out.columns if c != "__w"))
