"""Readers and writers of files, databases and message streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import parse_schema


def _schema(schema) -> T.StructType | None:
    if schema is None or isinstance(schema, T.StructType):
        return schema
    return parse_schema(schema)


def read_csv(spark: SparkSession, path: str, nulls: str = "", delimiter: str = ",", has_header: bool = True, schema=None) -> DataFrame:
    """A CSV file or folder. nulls: a list such as "<empty>,NA" of cells that mean null; <empty> is an empty cell.

    Without a schema (short form or StructType) a pass over the data finds long, double or string
    for each column after nulls are taken out. Without a header, names are col1, col2, ...
    """
    tokens = [x.strip() for x in nulls.split(",") if x.strip()]
    reader = spark.read.option("sep", delimiter).option("header", str(has_header).lower()).option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000")
    df = reader.csv(path)
    if not has_header:
        df = df.toDF(*(f"col{i + 1}" for i in range(len(df.columns))))
    words = [x for x in tokens if x != "<empty>"]
    for c in df.columns:
        x = F.col(f"`{c}`")
        gone = x.isin(words) if words else F.lit(False)
        gone = gone | (x == "") if "<empty>" in tokens else gone
        df = df.withColumn(c, F.when(~gone, x))
    want = _schema(schema)
    if want is not None:
        return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want))
    kinds = {}
    checks = []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        checks += [F.coalesce(F.bool_and(x.isNull() | x.rlike(r"^[+-]?\d{1,18}$")) & (F.count(x) > 0), F.lit(False)).alias(f"i{i}"), F.coalesce(F.bool_and(x.isNull() | x.try_cast("double").isNotNull()) & (F.count(x) > 0), F.lit(False)).alias(f"d{i}")]
    found = df.agg(*checks).first() if checks else None
    for i, c in enumerate(df.columns):
        kinds[c] = "long" if found[f"i{i}"] else "double" if found[f"d{i}"] else "string"
    return df.select(*(F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()))


def _written(df: DataFrame, write) -> int:
    """Writes in one pass and returns the number of rows."""
    from pyspark.sql import Observation

    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Nulls become empty cells; a quote is doubled. Returns the number of rows."""
    return _written(df, lambda d: d.write.mode(mode).option("header", "true").option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(path))


def read_json(spark: SparkSession, path: str, lines: bool = True, schema=None) -> DataFrame:
    """JSON lines, or with lines=False files of one object or an array of objects."""
    reader = spark.read.option("multiLine", str(not lines).lower())
    want = _schema(schema)
    df = (reader.schema(want) if want is not None else reader).json(path)
    return df.select(*(F.col(f"`{f.name}`").cast("long" if isinstance(f.dataType, T.IntegerType) else f.dataType).alias(f.name) for f in df.schema))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    return _written(df, lambda d: d.write.mode(mode).json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Whole numbers as long, floats as double; nested and decimal columns are an error."""
    df = spark.read.parquet(path)
    to = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            to[f.name] = F.col(f"`{f.name}`").cast("long")
        elif isinstance(f.dataType, T.FloatType):
            to[f.name] = F.col(f"`{f.name}`").cast("double")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.DecimalType, T.BinaryType)):
            raise TypeError(f"column {f.name} has type {f.dataType.simpleString()}")
    return df.withColumns(to) if to else df


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    return _written(df, lambda d: d.write.mode(mode).parquet(path))


def read_database(spark: SparkSession, url: str, sql: str, driver: str | None = None, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query's rows over JDBC; split (column, low, high, parts) reads in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    reader = reader.option("driver", driver) if driver else reader
    if split:
        column, low, high, parts = split
        return reader.option("dbtable", f"({sql}) AS q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()
    return reader.option("query", sql).load()


def kafka_recv(spark: SparkSession, servers: str, topic: str, schema, **options: str) -> DataFrame:
    """A stream of JSON messages as rows of a schema (short form or StructType)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), _schema(schema)).alias("r")).select("r.*")


def kafka_recv_avro(spark: SparkSession, servers: str, topic: str, avro_schema: str, **options: str) -> DataFrame:
    """A stream of registry-framed Avro messages: the five-byte frame is cut off."""
    from pyspark.sql.avro.functions import from_avro

    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(from_avro(F.expr("substring(value, 6)"), avro_schema).alias("r")).select("r.*")


def kafka_send(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None, **options: str):
    """Each row as a JSON message; a stream needs a checkpoint and gives its query."""
    rows = df.select(F.to_json(F.struct("*")).alias("value"))
    if df.isStreaming:
        return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).options(**options).start()
    return rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options).save()


# ---- synthetic data


def gen_ids(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(rows).withColumnRenamed("id", "n")


def gen_normal(spark: SparkSession, rows: int, mean: float = 0.0, sd: float = 1.0, seed: int = 1) -> DataFrame:
    return spark.range(rows).select("id", (F.randn(seed) * sd + mean).alias("x"))


def gen_uniform(spark: SparkSession, rows: int, low: float = 0.0, high: float = 1.0, seed: int = 1) -> DataFrame:
    return spark.range(rows).select("id", (F.rand(seed) * (high - low) + low).alias("x"))


def gen_walk(spark: SparkSession, rows: int, start: float = 100.0, step: float = 1.0, seed: int = 1, paths: int = 1) -> DataFrame:
    """Random walks: each path's running sum of normal steps, computed by path."""
    from pyspark.sql import Window as W

    base = spark.range(rows * paths).select((F.col("id") % paths).alias("path"), F.expr(f"id div {paths}").alias("n"), (F.randn(seed) * step).alias("d"))
    w = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    return base.select("path", "n", (F.lit(start) + F.sum("d").over(w)).alias("x"))


def gen_ticks(spark: SparkSession, rows: int, symbols: int = 10, start: str = "2024-01-01 09:30:00", every_ms: int = 100, seed: int = 1) -> DataFrame:
    """Trades of several symbols at even times: ts, symbol, price, qty."""
    walk = gen_walk(spark, max(1, rows // symbols), 100.0, 0.05, seed, symbols)
    ts = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + (F.col("n") * symbols + F.col("path")) * every_ms * 1000)
    return walk.select(ts.alias("ts"), F.concat(F.lit("S"), F.col("path").cast("string")).alias("symbol"), F.round("x", 4).alias("price"), (1 + F.floor(F.rand(seed + 1) * 500)).cast("long").alias("qty"))


# ---- Arrow


def from_arrow(spark: SparkSession, table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame):
    """All rows on the driver: for results, not for data."""
    return df.toArrow()
