"""Queries on joins, subqueries, reshaping and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import as_timeframe, rbind
from ..functions import aggregates as agg
from ..operators import joins, reshape
from .registry import Tables, query, r6

C = F.col


@query("SELECT o_orderkey, c_custkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_mapped(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_name"), {"o_custkey": "c_custkey"})


def _two(t: Tables):
    """All documents and all labels, under doubled ids, so that either side has keys the other has not."""
    return t.documents.select("doc_id", "n_chars"), t.labels.select(doc_id=C("doc_id") * 2, quality=C("quality"))


DOCS_LABELS = "documents d {} JOIN (SELECT doc_id * 2 AS doc_id, quality FROM labels) l USING (doc_id)"


@query(f"SELECT doc_id, n_chars, quality FROM {DOCS_LABELS.format('LEFT')}")
def join_left(t: Tables):
    a, b = _two(t)
    return a.join(b, "doc_id", "left")


@query(f"SELECT doc_id, n_chars, quality FROM {DOCS_LABELS.format('RIGHT')}")
def join_right(t: Tables):
    a, b = _two(t)
    return a.join(b, "doc_id", "right")


@query(f"SELECT doc_id, n_chars, quality FROM {DOCS_LABELS.format('FULL')}")
def join_outer(t: Tables):
    a, b = _two(t)
    return a.join(b, "doc_id", "outer")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(t: Tables):
    return t.customer.select("c_custkey").join(t.orders.filter(C("o_totalprice") > 200000), {"c_custkey": "o_custkey"}, "semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(t: Tables):
    return t.customer.select("c_custkey").join(t.orders.filter(C("o_totalprice") > 200000), {"c_custkey": "o_custkey"}, "anti")


@query("SELECT n_name, r_name FROM nation, region")
def join_cross(t: Tables):
    return t.nation.select("n_name").join(t.region.select("r_name"), how="cross")


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey >= r_regionkey AND n_nationkey < r_regionkey * 6")
def join_theta_range(t: Tables):
    return t.nation.select("n_nationkey", "n_regionkey").join(t.region.select("r_regionkey"), where=(C("l.n_regionkey") >= C("r.r_regionkey")) & (C("l.n_nationkey") < C("r.r_regionkey") * 6)).select("n_nationkey", "r_regionkey")


@query("SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey > r_regionkey + 2")
def join_theta_left(t: Tables):
    return t.nation.select("n_nationkey", "n_regionkey").join(t.region.select("r_regionkey"), how="left", where=C("l.n_regionkey") > C("r.r_regionkey") + 2).select("n_nationkey", "r_regionkey")


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE n_regionkey > r_regionkey + 2)")
def join_theta_anti(t: Tables):
    return t.nation.select("n_nationkey", "n_regionkey").join(t.region, how="anti", where=C("l.n_regionkey") > C("r.r_regionkey") + 2).select("n_nationkey")


@query("SELECT a.doc_id, a.source AS source_l, b.source AS source_r FROM documents a JOIN documents b ON a.doc_id = b.doc_id WHERE b.n_chars > 300")
def join_suffix(t: Tables):
    b = t.documents.filter(C("n_chars") > 300).select("doc_id", "source")
    return t.documents.select("doc_id", "source").join(b, "doc_id", suffix=("_l", "_r"))


NULLED = "(SELECT {0}, CASE WHEN {0} % 10 <> 0 THEN {0} % 50 END AS k FROM {1})"


@query(f"SELECT count(*) AS n FROM {NULLED.format('c_custkey', 'customer')} a JOIN {NULLED.format('s_suppkey', 'supplier')} b ON a.k IS NOT DISTINCT FROM b.k")
def join_nulls_equal(t: Tables):
    key = lambda c: F.when(C(c) % 10 != 0, C(c) % 50)
    return t.customer.select("c_custkey", k=key("c_custkey")).join(t.supplier.select("s_suppkey", k=key("s_suppkey")), "k", nulls="equal").select(n=agg.count())


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_expect_many_to_one(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_name"), {"o_custkey": "c_custkey"}, expect="n:1").select("o_orderkey", "o_custkey", "c_name")


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) o ON o_custkey = c_custkey AND n = 1""")
def join_take_first(t: Tables):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate").ordered("o_orderdate", "o_orderkey")
    return t.customer.select("c_custkey").join(o, {"c_custkey": "o_custkey"}, "left", take="first").select("c_custkey", "o_orderkey")


@query("""SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o ON o_custkey = c_custkey AND n = 1""")
def join_take_last(t: Tables):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate").ordered("o_orderdate", "o_orderkey")
    return t.customer.select("c_custkey").join(o, {"c_custkey": "o_custkey"}, take="last").select("c_custkey", "o_orderkey")


def _sides(t: Tables):
    a = t.events.filter(C("event_type") == "click").select("event_id", "ts", "user_id")
    b = t.events.filter(C("event_type") == "view").select("ts", "user_id", "event_id", quote=C("value"))
    return a, b._as(b.df.drop("event_id"))


@query("""SELECT l.event_id, r.quote FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT ts, value AS quote FROM events WHERE event_type = 'view') r ON l.ts >= r.ts""")
def join_asof(t: Tables):
    a, b = _sides(t)
    return as_timeframe(a.select("event_id", "ts"), "ts").asof(as_timeframe(b.select("ts", "quote"), "ts")).select("event_id", "quote")


@query("""SELECT l.event_id, r.quote FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT ts, user_id, value AS quote FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def join_asof_by(t: Tables):
    a, b = _sides(t)
    return a.asof(as_timeframe(b, "ts"), by=["user_id"]).select("event_id", "quote")


@query("SELECT l_orderkey, l_quantity FROM lineitem l WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
def subquery_correlated(t: Tables):
    limits = t.lineitem.select(by="l_partkey", least=0.2 * agg.mean("l_quantity"))
    return joins.with_scalar(t.lineitem.df, limits.df, "least", "least", "l_partkey").where("l_quantity < least").select("l_orderkey", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def subquery_uncorrelated(t: Tables):
    mean = t.orders.select(m=agg.mean("o_totalprice")).df
    return joins.with_scalar(t.orders.df, mean, "m", "m").where("o_totalprice > m").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) UNPIVOT (value FOR variable IN (l_quantity, l_tax))")
def melt(t: Tables):
    return t.lineitem.block(melt=["l_orderkey", "l_linenumber"], select=["l_quantity", "l_tax"])


@query("""SELECT user_id, max_by(value, ts) FILTER (event_type = 'click') AS click, max_by(value, ts) FILTER (event_type = 'view') AS "view" FROM events GROUP BY 1""")
def dcast(t: Tables):
    return t.events.dcast("event_type", "value", ["user_id"], ["click", "view"])


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def rbind_names(t: Tables):
    return rbind(t.nation.select(name=C("n_name")), t.region.select(name=C("r_name")))


@query("""SELECT 'a' AS "column", round(covar_samp(p_size, p_size), 6) AS a, round(covar_samp(p_size, p_retailprice), 6) AS b FROM part
  UNION ALL SELECT 'b', round(covar_samp(p_retailprice, p_size), 6), round(covar_samp(p_retailprice, p_retailprice), 6) FROM part""")
def cov_matrix(t: Tables):
    return t.part.select(a=C("p_size").cast("double"), b=C("p_retailprice")).cov().select("column", a=r6(C("a")), b=r6(C("b")))


@query("""SELECT 'a' AS "column", 1.0::DOUBLE AS a, round(corr(l_quantity, l_extendedprice), 6) AS b, 0.0::DOUBLE AS c FROM lineitem
  UNION ALL SELECT 'b', round(corr(l_quantity, l_extendedprice), 6), 1.0, 0.0 FROM lineitem UNION ALL SELECT 'c', 0.0, 0.0, 1.0""")
def corr_matrix(t: Tables):
    out = t.lineitem.select(a=C("l_quantity"), b=C("l_extendedprice"), c=F.lit(1.0)).corr()
    return out.select("column", a=r6(C("a")), b=r6(C("b")), c=C("c"))


@query("""WITH s AS (SELECT o_orderstatus, count(*)::DOUBLE AS n, max(o_totalprice) AS hi FROM orders GROUP BY 1)
  SELECT 'n' AS "column", max(n) FILTER (o_orderstatus = 'F') AS "F", max(n) FILTER (o_orderstatus = 'O') AS "O", max(n) FILTER (o_orderstatus = 'P') AS "P" FROM s
  UNION ALL SELECT 'hi', max(hi) FILTER (o_orderstatus = 'F'), max(hi) FILTER (o_orderstatus = 'O'), max(hi) FILTER (o_orderstatus = 'P') FROM s""")
def transpose_labels(t: Tables):
    s = t.orders.select(by="o_orderstatus", n=agg.count().cast("double"), hi=agg.max("o_totalprice"))
    return s.ordered("o_orderstatus").transpose().select("column", "F", "O", "P")


@query("SELECT round(p_size * 1.0 + p_retailprice * 3.0, 6) AS u, round(p_size * 2.0 + p_retailprice * 4.0, 6) AS v FROM part")
def matmul(t: Tables):
    b = reshape.table(t.spark, {"i": ["0", "1"], "u": [1.0, 3.0], "v": [2.0, 4.0]})
    return reshape.matmul(t.part.df.select("p_size", "p_retailprice"), b, ["i"]).select(F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b'), (3, NULL)) v(id, name)")
def table_literal(t: Tables):
    return reshape.table(t.spark, {"id": [1, 2, 3], "name": ["a", "b", None]}, schema="id long, name string")


@query("SELECT 'r_regionkey' AS name UNION ALL SELECT 'r_name'")
def columns_of(t: Tables):
    return t.region.columns()


@query("SELECT n_nationkey, CAST(((n_nationkey // 2) % 25) AS INTEGER) AS twice FROM nation")
def rep_each(t: Tables):
    return reshape.rep(t.nation.df.select("n_nationkey"), "twice", "n_nationkey", ["n_nationkey"], each=2)
