"""Files, schemas, generators and streams."""

import pytest
from pyspark.sql import functions as F

from tidewater.sources import io
from tidewater.sources.schemas import parse_schema, time_column
from tidewater.streaming import streams


def test_csv_null_tokens_and_inference(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v,s,e\n1,1.5,"a ""q""",\n2,NA,b,\n3,2,NA,\n')
    df = io.read_csv(spark, str(tmp_path / "a.csv"), nulls="<empty>,NA")
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "string"]
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, 1.5, 'a "q"', None), (2, None, "b", None), (3, 2.0, None, None)]


def test_csv_without_header_and_with_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1;x\n2;y\n")
    assert io.read_csv(spark, str(tmp_path / "a.csv"), delimiter=";", has_header=False).columns == ["col1", "col2"]
    df = io.read_csv(spark, str(tmp_path / "a.csv"), delimiter=";", has_header=False, schema=None)
    assert df.count() == 2


def test_writers_count_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 'b"')], "k long, s string")
    assert io.write_csv(df, str(tmp_path / "c")) == 2
    assert io.write_json(df, str(tmp_path / "j")) == 2
    assert io.write_parquet(df, str(tmp_path / "p")) == 2
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "c"), nulls="<empty>").collect()), key=repr) == [(1, None), (2, 'b"')]
    assert sorted(map(tuple, io.read_json(spark, str(tmp_path / "j")).select("k", "s").collect()), key=repr) == [(1, None), (2, 'b"')]


def test_parquet_types(spark, tmp_path):
    spark.createDataFrame([(1, 1.5)], "i int, f float").write.parquet(str(tmp_path / "a"))
    assert io.read_parquet(spark, str(tmp_path / "a")).dtypes == [("i", "bigint"), ("f", "double")]
    spark.createDataFrame([([1],)], "a array<int>").write.parquet(str(tmp_path / "b"))
    with pytest.raises(TypeError):
        io.read_parquet(spark, str(tmp_path / "b"))


def test_schema_short_form():
    s = parse_schema("ts:ts,symbol:str,price:f64")
    assert time_column(s) == "ts" and s["price"].dataType.simpleString() == "double"
    with pytest.raises(ValueError):
        parse_schema("a:what")


def test_generators(spark):
    assert io.gen_ticks(spark, 100, 5).count() == 100
    assert io.gen_walk(spark, 10, paths=2).count() == 20


def test_arrow_round_trip(spark):
    df = spark.createDataFrame([(1, "a")], "k long, s string")
    assert io.from_arrow(spark, io.to_arrow(df)).collect() == df.collect()


def test_stream_sink_sees_each_batch(spark, tmp_path):
    df = spark.range(10)
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = streams.to_sink(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda d: d.where("id % 2 = 0"), lambda d, n: seen.append(d.count()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sum(seen) == 5


def test_the_last_bucket_is_given_out(spark, tmp_path):
    df = spark.range(10).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = streams.bucket_stream(source, "ts", "30 seconds", [], [F.count("*").alias("n")])
    assert sorted(r["n"] for r in out.collect()) == [1, 3, 3, 3]
