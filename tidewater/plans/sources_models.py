"""Queries through sources and sinks, generators, functions from outside, models, and rules that refuse."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from ..frame import Frame, as_timeframe
from ..functions import aggregates as agg
from ..functions import scalars as sc
from ..functions import windows as win
from ..functions.externs import Externs
from ..operators import joins, models
from ..session import scratch_folder
from ..sources import io
from ..verbs import run_cell, verbs
from .registry import Tables, query, r6

C = F.col
PART = "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"


def _refused(t: Tables, *attempts):
    """One row that says whether every attempt is an error."""

    def fails(f) -> bool:
        try:
            f()
        except (ValueError, TypeError):
            return True
        return False

    return t.spark.createDataFrame([(all(fails(f) for f in attempts),)], "refused boolean")


@query(PART)
def csv_round_trip(t: Tables):
    """Several files written, read with a schema in short form."""
    path = scratch_folder(t.spark, "csv")
    io.write_csv(t.df("part").repartition(4, "p_partkey"), path)
    return io.read_csv(t.spark, path, schema="p_partkey:i64,p_name:str,p_brand:str,p_type:str,p_size:i64,p_retailprice:f64")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, c_acctbal FROM customer")
def csv_inferred_with_nulls(t: Tables):
    path = scratch_folder(t.spark, "csv")
    segment = F.when(C("c_mktsegment") == "BUILDING", "NA").otherwise(C("c_mktsegment"))
    io.write_csv(t.df("customer").select("c_custkey", segment.alias("segment"), "c_acctbal"), path)
    return io.read_csv(t.spark, path, nulls="<empty>,NA")


@query("SELECT c_custkey, c_name, c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def json_round_trip(t: Tables):
    path = scratch_folder(t.spark, "json")
    io.write_json(t.df("customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), path)
    return io.read_json(t.spark, path, schema="c_custkey:i64,c_name:str,c_acctbal:f64,c_nationkey:i64")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def parquet_round_trip(t: Tables):
    path = scratch_folder(t.spark, "parquet")
    io.write_parquet(t.df("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), path)
    return io.read_parquet(t.spark, path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def arrow_round_trip(t: Tables):
    return io.from_arrow(t.spark, io.to_arrow(t.df("nation")))


@query("SELECT range AS n FROM range(5000)")
def generated_ids(t: Tables):
    return io.gen_ids(t.spark, 5000)


@query("SELECT 'S' || (i % 10) AS symbol, count(*) AS n, TIMESTAMP '2024-01-01 09:30:00' + INTERVAL (min(i) * 100) MILLISECOND AS since, true AS sound FROM range(1000) r(i) GROUP BY 1")
def generated_ticks(t: Tables):
    rows = io.gen_ticks(t.spark, 1000)
    sound = F.bool_and((C("price") > 0) & C("qty").between(1, 500))
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("since"), sound.alias("sound"))


#: Name, draw, mean and standard deviation of what is drawn.
DRAWS = {
    "uniform": (lambda: sc.rand_uniform(2, 6, 11), 4.0, 4 / math.sqrt(12)), "normal": (lambda: sc.rand_normal(3, 2, 12), 3.0, 2.0), "exponential": (lambda: sc.rand_exponential(0.5, 13), 2.0, 2.0),
    "bernoulli": (lambda: sc.rand_bernoulli(0.25, 14), 0.25, math.sqrt(0.1875)), "int": (lambda: sc.rand_int(1, 6, 15), 3.5, math.sqrt(35 / 12)), "gamma": (lambda: sc.rand_gamma(2.0, 3.0, 16), 6.0, 3 * math.sqrt(2)),
    "student": (lambda: sc.rand_student_t(6.0, 17), 0.0, math.sqrt(1.5)), "poisson": (lambda: sc.rand_poisson(4.0, 18), 4.0, 2.0),
}


@query(f"SELECT unnest([{', '.join(repr(k) for k in DRAWS)}]) AS kind, true AS fits")
def random_distributions(t: Tables):
    """Means within five standard errors and standard deviations within a tenth, over 40,000 draws each."""
    n = 40_000
    rows = t.spark.range(n).select(*(draw().cast("double").alias(k) for k, (draw, _, _) in DRAWS.items()))
    one = rows.agg(*(((F.abs(F.avg(k) - m) < 5 * s / math.sqrt(n)) & (F.abs(F.stddev_samp(k) / s - 1) < 0.1)).alias(k) for k, (_, m, s) in DRAWS.items()))
    return one.unpivot([], list(DRAWS), "kind", "fits")


@query("SELECT true AS equal")
def seeded_draws_agree(t: Tables):
    out = []
    for _ in range(2):
        sc.seed_rng(7)
        out.append(t.spark.range(100, numPartitions=4).select("id", sc.rand_uniform().alias("u"), sc.rand_normal().alias("n")))
    sc.seed_rng(None)
    return out[0].join(out[1].withColumnsRenamed({"u": "u2", "n": "n2"}), "id").agg(F.bool_and((C("u") == C("u2")) & (C("n") == C("n2"))).alias("equal"))


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS i, CAST(p_retailprice AS FLOAT) AS f FROM part")
def casts_32_bit(t: Tables):
    return t.part.select("p_partkey", i=sc.to_int32("p_size"), f=sc.to_float32("p_retailprice"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def ascribed_schema(t: Tables):
    return t.nation.ascribe("n_nationkey int, n_name string, n_regionkey int").filter(C("n_regionkey") == 1).select("n_nationkey", "n_name")


@query("SELECT c_custkey, round(c_acctbal - (SELECT max(c_acctbal) FROM customer), 6) AS below FROM customer")
def scalar_value(t: Tables):
    best = joins.scalar(t.customer.select(m=agg.max("c_acctbal")).df, "m")
    return t.customer.select("c_custkey", below=F.round(C("c_acctbal") - best, 6))


@query("""SELECT make_timestamp(epoch_us(ts) // (30 * 86400000000) * (30 * 86400000000)) AS ts, count(*) AS n FROM events GROUP BY 1""")
def resample_thirty_days(t: Tables):
    return t.events.resample("1mo", n=agg.count())


@query("SELECT true AS refused")
def rules_that_refuse(t: Tables):
    """Nested aggregates, lags over rows of several groups, excluded clauses, wrong types, clashing columns."""
    grouped = t.events.window("1h", by="user_id", update={"m": agg.mean("value")})
    buckets = t.events.resample("1d", by="user_id", n=agg.count())
    return _refused(
        t, lambda: agg.sum(agg.mean("value")), lambda: grouped.update(x=win.lag("value")), lambda: as_timeframe(buckets, "ts").update(x=win.cumsum("n")), lambda: grouped.window("1h", update={"y": agg.sum("value")}),
        lambda: t.part.block(distinct=["p_size"], update={"x": C("p_size")}), lambda: t.part.ascribe("p_size string"), lambda: t.nation.join(t.nation, "n_nationkey"), lambda: t.events.filter(agg.count() > 1),
    )


@query("""WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) // 21600000000 AS h FROM events), p AS (SELECT *, h * 200000 + row_number() OVER (PARTITION BY user_id, h ORDER BY event_id) AS k FROM e)
  SELECT event_id, round(sum(value) OVER w, 6) AS s, count(*) OVER w AS n, round(median(value) OVER w, 6) AS med, round(quantile_cont(value, 0.25) OVER w, 6) AS q, round(coalesce(stddev_samp(value) OVER w, 0), 5) AS sd,
    first(value) OVER w AS f, last(value) OVER w AS l, max(value) OVER w AS hi FROM p WINDOW w AS (PARTITION BY user_id ORDER BY k RANGE BETWEEN 499999 PRECEDING AND CURRENT ROW)""")
def roll_tied_times(t: Tables):
    """Times in steps of six hours, so that many are tied; 18 hours see three of them, the last up to the row itself."""
    ts = F.timestamp_micros(F.expr("unix_micros(CAST(ts AS timestamp)) div 21600000000 * 21600000000"))
    tied = as_timeframe(Frame(t.df("events").withColumn("ts", ts)).ordered("event_id"), "ts")
    f = {
        "s": r6(agg.sum("value")), "n": agg.count(), "med": r6(win.rolling_median("value")), "q": r6(win.rolling_quantile("value", 0.25)), "sd": win.rolling_std("value").map(lambda x: F.round(x, 5)),
        "f": win.rolling_first("value"), "l": win.rolling_last("value"), "hi": win.rolling_max("value"),
    }
    return tied.window("18h", by="user_id", update=f).select("event_id", *f)


@query("SELECT n_nationkey, CAST(n_nationkey * 2 + n_regionkey AS DOUBLE) AS y FROM nation")
def extern_scalar(t: Tables):
    x = Externs()
    x.scalar("mixed", lambda a, b: a * 2.0 + b, "double", takes=2)
    return t.nation.select("n_nationkey", y=x.call("mixed", "n_nationkey", "n_regionkey"))


@query("SELECT range AS i, range * range AS square FROM range(20)")
def udtf_source(t: Tables):
    x = Externs()
    x.table("squares", lambda n: ((i, i * i) for i in range(n)), "i long, square long")
    return x.read(t.spark, "squares", 20)


@query("SELECT r_regionkey, r_name, CAST(i AS BIGINT) AS i FROM region, range(5) g(i) WHERE i < r_regionkey")
def udtf_lateral(t: Tables):
    x = Externs()
    x.table("below", lambda n: ((i,) for i in range(n)), "i long")
    return x.expand(t.df("region"), "below", "r_regionkey")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def table_consumer(t: Tables):
    """A table function with a contract on what it takes, and a sink that says how many rows it took."""
    path, x = scratch_folder(t.spark, "taken"), Externs()
    x.consumer("keep", lambda d: io.write_parquet(Frame(d).ascribe("s_suppkey long, s_acctbal double").df, path))
    rows = t.supplier.filter(C("s_acctbal") > 0).select("s_suppkey", "s_acctbal").df
    if x.send(rows, "keep") != rows.count():
        raise ValueError("the consumer did not take every row")
    return io.read_parquet(t.spark, path)


@query("""WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx,
    regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem), e AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS v FROM s)
  SELECT '(Intercept)' AS term, round(a, 3) AS estimate, round(sqrt(v * (1 / n + mx * mx / sxx)), 3) AS std_error, round(a / sqrt(v * (1 / n + mx * mx / sxx)), 3) AS t_stat, true AS sound FROM e
  UNION ALL SELECT 'l_quantity', round(b, 3), round(sqrt(v / sxx), 3), round(b / sqrt(v / sxx), 3), true FROM e""")
def model_summary(t: Tables):
    s = t.lineitem.model("l_extendedprice ~ l_quantity").summary()
    return s.select("term", *(F.round(c, 3).alias(c) for c in ("estimate", "std_error", "t_stat")), C("p_value").between(0, 1).alias("sound"))


@query("""WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT p_partkey, round(a + b * p_size, 3) AS prediction FROM part, s""")
def model_predict(t: Tables):
    m = t.lineitem.model("l_extendedprice ~ l_quantity")
    new = t.df("part").select("p_partkey", C("p_size").cast("double").alias("l_quantity"))
    return new.select("p_partkey", F.round(m._predicted(), 3).alias("prediction"))


@query("""WITH m AS (SELECT l_returnflag AS f, avg(l_quantity) AS a FROM lineitem GROUP BY 1), b AS (SELECT a FROM m ORDER BY f LIMIT 1)
  SELECT CASE WHEN f = (SELECT min(f) FROM m) THEN '(Intercept)' ELSE 'l_returnflag' || f END AS term, round(CASE WHEN f = (SELECT min(f) FROM m) THEN m.a ELSE m.a - b.a END, 5) AS estimate FROM m, b""")
def model_of_levels(t: Tables):
    """Text as dummies: each estimate is a difference of group means."""
    return t.lineitem.model("l_quantity ~ l_returnflag").coef().select("term", F.round("estimate", 5).alias("estimate"))


@query("SELECT round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(sum(l_extendedprice), 2) AS fitted, CAST(0 AS DOUBLE) AS residual FROM lineitem")
def model_fit(t: Tables):
    m = t.lineitem.model("l_extendedprice ~ l_quantity")
    both = m.fitted().agg(F.round(F.sum("fitted"), 2).alias("fitted")).crossJoin(F.broadcast(m.residuals().agg((F.round(F.avg("residual"), 6) + 0.0).alias("residual"))))
    return both.select(F.lit(round(m.r_squared, 6)).alias("r2"), "fitted", F.abs("residual").alias("residual"))


@query("SELECT true AS sound")
def kmeans_groups(t: Tables):
    """Two far groups of points are told apart."""
    p = t.df("part").select(F.when(C("p_partkey") % 2 == 0, C("p_size")).otherwise(C("p_size") + 10000).alias("x"), (C("p_partkey") % 2).alias("g"))
    m = models.fit(p, "~ x", "kmeans", k=2)
    split = m.predict(p.where("g = 0")).distinct().withColumn("g", F.lit(0)).union(m.predict(p.where("g = 1")).distinct().withColumn("g", F.lit(1)))
    return split.agg(((F.count("*") == 2) & (F.count_distinct("cluster") == 2)).alias("sound"))


@query("SELECT round(var_samp(p_size) + var_samp(p_retailprice), 2) AS total, true AS ordered FROM part")
def pca_keeps_variance(t: Tables):
    s = models.fit(t.df("part"), "~ p_size + p_retailprice - 1", "pca", k=2).fitted()
    return s.agg(F.round(F.var_samp("pc1") + F.var_samp("pc2"), 2).alias("total"), (F.var_samp("pc1") >= F.var_samp("pc2")).alias("ordered"))


@query("SELECT true AS better")
def boosted_trees_fit(t: Tables):
    """Trees come nearer than the mean on a step that no line fits."""
    p = t.df("part").select(C("p_size").cast("double").alias("x"), F.when(C("p_size").between(10, 30), 5.0).otherwise(-5.0).alias("y"))
    f = models.fit(p, "y ~ x", "gbt", iterations=3).predict(p.withColumn("y", C("y")))
    return f.agg((F.max("prediction") > 4).alias("hi"), (F.min("prediction") < -4).alias("lo")).select((C("hi") & C("lo")).alias("better"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 3")
def shown_rows(t: Tables):
    """What show() would print, read back."""
    text = t.nation.head(3, order=["n_nationkey"]).select("n_nationkey", "n_name").text(3)
    cells = [[x.strip() for x in line.strip("|").split("|")] for line in text.splitlines() if line.startswith("|")][1:]
    return t.spark.createDataFrame(pd.DataFrame([(int(a), b) for a, b in cells], columns=["n_nationkey", "n_name"])).select(C("n_nationkey").cast("int"), "n_name")


@query("""WITH a AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer WHERE c_acctbal > 0 GROUP BY ALL)
  SELECT c_mktsegment AS segment, n_name, n, total, row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, n_name) AS place FROM a JOIN nation ON n_nationkey = c_nationkey QUALIFY place <= 3""")
def verbs_chain(t: Tables):
    v = verbs(t.customer).filter(C("c_acctbal") > 0).group_by("c_mktsegment", "c_nationkey").summarise(n=agg.count(), total=agg.sum("c_acctbal").map(lambda x: F.round(x, 4))).ungroup()
    v = v.inner_join(verbs(t.nation).select("n_name", c_nationkey="n_nationkey")).rename(segment="c_mktsegment")
    best = v.group_by("segment").slice_head(3, order=[("total", "desc"), "n_name"])
    ranked = best.mutate(place=win.rank([("total", False), ("n_name", True)], "min"))
    return ranked.select("n_name", "n", "total", "place").frame


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 1")
def notebook_cell(t: Tables):
    """What a cell of SQL over the frames of a notebook gives, and keeps under a name."""
    names = {"land": t.nation, "_hidden": t.region, "x": 3}
    out = run_cell("kept", "SELECT n_regionkey, count(*) AS n FROM land GROUP BY 1 HAVING count(*) > 1", names)
    return names["kept"] if names["kept"] is out else None
