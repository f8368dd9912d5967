"""Queries on scalar functions, models, random columns, streams and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import models
from .registry import Tables, query, r6

C = F.col


@query("""SELECT p_partkey, round(sqrt(p_size), 6) AS sq, round(ln(p_retailprice), 6) AS ln, round(log2(p_retailprice), 6) AS l2, round(log10(p_retailprice), 6) AS l10, round(exp(p_size / 50.0), 6) AS ex,
  round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 6) AS t, round(atan(p_size), 6) AS at, ceil(p_retailprice) AS ce, floor(p_retailprice) AS fl, trunc(p_retailprice) AS tr, abs(p_retailprice - 1000) AS ab FROM part""")
def math_functions(t: Tables):
    x, p = C("p_size").cast("double"), C("p_retailprice")
    return t.part.select("p_partkey", sq=r6(F.sqrt(x)), ln=r6(sc.log(p)), l2=r6(sc.log2(p)), l10=r6(sc.log10(p)), ex=r6(F.exp(x / 50.0)), s=r6(F.sin(x)), c=r6(F.cos(x)), t=r6(F.tan(x)), at=r6(F.atan(x)), ce=sc.ceil(p), fl=sc.floor(p), tr=sc.trunc(p), ab=F.abs(p - 1000))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'inf' ELSE 'finite' END AS kind, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_partkey % (p_size % 5) END AS m FROM part""")
def safe_div_mod(t: Tables):
    d = C("p_size") % 5
    q = sc.div(C("p_partkey") + 1, d)
    return t.part.select("p_partkey", kind=F.when(q == float("inf"), "inf").otherwise("finite"), m=sc.mod(C("p_partkey"), d).cast("long"))


@query("""SELECT p_partkey, CAST(round(h) AS BIGINT) AS near, CAST(round_even(h, 0) AS BIGINT) AS bank, CAST(floor(h) AS BIGINT) AS fl, CAST(ceil(h) AS BIGINT) AS ce, CAST(trunc(h) AS BIGINT) AS tr FROM (SELECT p_partkey, (p_size - 25) / 2.0 AS h FROM part)""")
def round_modes(t: Tables):
    h = (C("p_size") - 25) / 2.0
    return t.part.select("p_partkey", near=sc.round_(h), bank=sc.round_(h, "bankers"), fl=sc.round_(h, "floor"), ce=sc.round_(h, "ceil"), tr=sc.round_(h, "trunc"))


@query("""SELECT p_partkey, CASE WHEN x IS NOT NULL THEN least(x, 20) END AS lo, CASE WHEN x IS NOT NULL THEN greatest(x, 20) END AS hi FROM (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size END AS x FROM part)""")
def pmin_pmax_nulls(t: Tables):
    x = F.when(C("p_size") % 3 != 0, C("p_size"))
    return t.part.select("p_partkey", lo=sc.pmin(x, F.lit(20)), hi=sc.pmax(x, F.lit(20)))


@query("SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS DOUBLE) AS n, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity > 25 AS BIGINT) AS b FROM lineitem")
def casts(t: Tables):
    return t.lineitem.select("l_orderkey", q=sc.to_int("l_quantity"), n=sc.to_float("l_linenumber"), d=sc.to_date("l_shipdate"), b=sc.to_int(C("l_quantity") > 25))


@query("""SELECT p_partkey, p_size % 4 = 0 AS nan, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS clean, coalesce(CASE WHEN p_size % 4 <> 0 THEN p_retailprice END, -1) AS filled FROM part""")
def nan_cleaning(t: Tables):
    x = F.when(C("p_size") % 4 == 0, float("nan")).otherwise(C("p_retailprice"))
    return t.part.select("p_partkey", nan=sc.is_nan(x), clean=sc.null_if_nan(x), filled=sc.fill_null(sc.null_if_not_finite(x), -1.0))


@query("SELECT doc_id, length(text) AS n, strlen(text) AS b, text LIKE '%the%' AS the, text LIKE '_n%' AS an FROM documents")
def string_functions(t: Tables):
    return t.documents.select("doc_id", n=F.char_length("text").cast("long"), b=F.octet_length("text").cast("long"), the=sc.like("text", "%the%"), an=sc.like("text", "_n%"))


@query("SELECT p_partkey, p_brand LIKE 'Brand#1_' AS one, p_brand LIKE '%#2%' AS two FROM part")
def like_patterns(t: Tables):
    return t.part.select("p_partkey", one=sc.like("p_brand", r"Brand\#1_"), two=sc.like("p_brand", "%#2%"))


@query("SELECT p_partkey, substr(p_brand, 3, 2) AS a, right(p_brand, 3) AS b, p_brand AS c FROM part")
def substring_clamp(t: Tables):
    return t.part.select("p_partkey", a=sc.substring("p_brand", 2, 2), b=sc.substring("p_brand", -3), c=sc.substring("p_brand", -99, 99))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders")
def date_parts(t: Tables):
    o = C("o_orderdate")
    return t.orders.select("o_orderkey", y=F.year(o), m=F.month(o), d=F.day(o), h=F.hour(o), days=sc.date_diff_days(o.cast("date"), F.lit("1992-01-01").cast("date")))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band FROM part")
def case_expressions(t: Tables):
    return t.part.select("p_partkey", band=sc.case((C("p_size") < 10, "small"), (C("p_size") < 30, "medium"), default="large"))


@query("SELECT d.doc_id, coalesce(l.quality, l.toxic, -1) AS q FROM documents d LEFT JOIN labels l USING (doc_id)")
def coalesce_fill_null(t: Tables):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.select("doc_id", q=sc.fill_null(F.coalesce("quality", "toxic"), -1))


@query("SELECT n_nationkey, 'nation ' || n_name || ' of ' || CAST(n_regionkey AS VARCHAR) AS text FROM nation")
def interpolation(t: Tables):
    return t.nation.select("n_nationkey", text=sc.interp("nation ", C("n_name"), " of ", C("n_regionkey")))


@query("""SELECT '(Intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def ols(t: Tables):
    return t.lineitem.model("l_extendedprice ~ l_quantity").coef().select("term", F.round("estimate", 4).alias("estimate"))


@query("""WITH s AS (SELECT count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy FROM lineitem)
  SELECT '(Intercept)' AS term, round((y - (n * xy - x * y) / (n * (xx + 100) - x * x) * x) / n, 4) AS estimate FROM s UNION ALL SELECT 'l_quantity', round((n * xy - x * y) / (n * (xx + 100) - x * x), 4) FROM s""")
def ridge(t: Tables):
    return t.lineitem.model("l_extendedprice ~ l_quantity", "ridge", lambda_=100.0).coef().select("term", F.round("estimate", 4).alias("estimate"))


@query("""WITH s AS (SELECT sum(w) AS n, sum(w * l_quantity) AS x, sum(w * l_extendedprice) AS y, sum(w * l_quantity * l_quantity) AS xx, sum(w * l_quantity * l_extendedprice) AS xy FROM (SELECT *, l_tax + 0.01 AS w FROM lineitem))
  SELECT '(Intercept)' AS term, round((y - (n * xy - x * y) / (n * xx - x * x) * x) / n, 4) AS estimate FROM s UNION ALL SELECT 'l_quantity', round((n * xy - x * y) / (n * xx - x * x), 4) FROM s""")
def wls(t: Tables):
    return t.lineitem.update(w=C("l_tax") + 0.01).model("l_extendedprice ~ l_quantity", "wls", weights="w").coef().select("term", F.round("estimate", 4).alias("estimate"))


@query()
def kmeans(t: Tables):
    return models.fit(t.part.df, "~ p_size + p_retailprice", "kmeans", k=3).fitted()


@query()
def pca(t: Tables):
    return models.fit(t.part.df, "~ p_size + p_retailprice - 1", "pca", k=2).fitted()


@query()
def boosted_trees(t: Tables):
    return models.fit(t.part.df, "p_retailprice ~ p_size", "gbt", iterations=3).importance()


@query()
def rng_all(t: Tables):
    return t.part.select("p_partkey", u=sc.rand_uniform(0, 1, 1), n=sc.rand_normal(0, 1, 2), e=sc.rand_exponential(1.0, 3), b=sc.rand_bernoulli(0.5, 4), i=sc.rand_int(1, 6, 5), g=sc.rand_gamma(2.0, 1.0, 6), s=sc.rand_student_t(5.0, 7), p=sc.rand_poisson(3.0, 8))


@query("SELECT n_nationkey, CAST(n_nationkey * 2.5 AS DOUBLE) AS y FROM nation")
def pandas_udf_scalar(t: Tables):
    import pandas as pd

    def f(x):
        return x * 2.5

    f.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return t.nation.select("n_nationkey", y=F.pandas_udf(f, "double")("n_nationkey"))


@query("SELECT event_id, value * 2 AS twice FROM events WHERE value > 50")
def stream_per_row(t: Tables):
    from ..streaming.streams import run_stream

    source = t.spark.readStream.schema(t.df("events").schema).parquet(f"{t.folder}/events.parque[t]")
    return run_stream(source, lambda d: d.where("value > 50").select("event_id", (C("value") * 2).alias("twice")))


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS ts, count(*) AS n FROM events GROUP BY 1""")
def stream_time_bucket(t: Tables):
    from ..streaming.streams import bucket_stream

    source = t.spark.readStream.schema(t.df("events").schema).parquet(f"{t.folder}/events.parque[t]")
    return bucket_stream(source, "ts", "1 day", [], [F.count("*").alias("n")])


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS ts, event_type, count(*) AS n, round(sum(value), 6) AS s FROM events GROUP BY 1, 2""")
def stream_bucket_by_clock(t: Tables):
    """Batches by the clock give open buckets out as well; the run ends after a while."""
    from ..streaming.streams import bucket_stream

    source = t.spark.readStream.schema(t.df("events").schema).parquet(f"{t.folder}/events.parque[t]")
    out = bucket_stream(source, "ts", "1 day", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("s")], every="1 second", timeout=15)
    return out.select("ts", "event_type", "n", F.round("s", 6).alias("s"))


@query("SELECT 'per_row' AS kind, count(*) AS n FROM events WHERE value > 50")
def stream_kind_by_row(t: Tables):
    from ..streaming.streams import stream

    source = t.spark.readStream.schema(t.df("events").schema).parquet(f"{t.folder}/events.parque[t]")
    kind, rows = stream(source, lambda d: d.where("value > 50").select("event_id"))
    return rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))


@query("""SELECT 'time_bucket' AS kind, time_bucket(INTERVAL '1 day', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 day', ts) < (SELECT time_bucket(INTERVAL '1 day', max(ts)) FROM events)""")
def stream_kind_of_buckets(t: Tables):
    """Appended buckets are those that a later row has closed."""
    from ..streaming.streams import stream

    source = t.spark.readStream.schema(t.df("events").schema).parquet(f"{t.folder}/events.parque[t]")
    kind, rows = stream(source, lambda d: d.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("ts"), "n"), "ts")
    return rows.select(F.lit(kind).alias("kind"), "ts", "n")
