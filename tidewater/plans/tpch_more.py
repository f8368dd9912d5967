"""More queries in the shape of well-known order-processing ones.

There is no table of offers here: what a supplier asks for a part is the least unit price among the
lines on which it supplied that part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import Frame
from ..functions import aggregates as agg
from ..operators.joins import with_scalar
from ..session import spread
from .registry import Tables, query

L = F.col


def net():
    return L("l_extendedprice") * (1 - L("l_discount"))


def r4(e):
    return e.map(lambda x: F.round(x, 4))


@query("""WITH o AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size = 15
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey AND r_name = 'EUROPE' GROUP BY ALL)
  SELECT round(s_acctbal, 4) AS s_acctbal, s_name, n_name, l_partkey AS p_partkey, cost FROM o JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  WHERE cost = (SELECT min(cost) FROM o i WHERE i.l_partkey = o.l_partkey)""")
def q02_least_cost_supplier(t: Tables):
    n = t.nation.join(t.region.filter(L("r_name") == "EUROPE"), {"n_regionkey": "r_regionkey"}, "semi").select("n_nationkey", "n_name")
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal", "s_nationkey").join(n, {"s_nationkey": "n_nationkey"}).select("s_suppkey", "s_name", "s_acctbal", "n_name")
    p = t.part.filter(L("p_size") == 15).select("p_partkey")
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").join(p, {"l_partkey": "p_partkey"}, "semi").join(s.select("s_suppkey"), {"l_suppkey": "s_suppkey"}, "semi")
    offers = li.select(by=["l_partkey", "l_suppkey"], cost=agg.min(L("l_extendedprice") / L("l_quantity")))
    best = offers.update(by="l_partkey", least=agg.min("cost")).filter(L("cost") == L("least"))
    return best.join(s, {"l_suppkey": "s_suppkey"}).select("s_name", "n_name", "cost", p_partkey=L("l_partkey"), s_acctbal=F.round("s_acctbal", 4))


@query("""SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1997-07-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY 1""")
def q04_order_priority(t: Tables):
    o = t.orders.filter((L("o_orderdate") >= "1996-07-01") & (L("o_orderdate") < "1997-07-01")).select("o_orderkey", "o_orderdate", "o_orderpriority")
    late = o.join(t.lineitem.select("l_orderkey", "l_shipdate"), {"o_orderkey": "l_orderkey"}, "semi", where=L("r.l_shipdate") > L("l.o_orderdate"))
    return late.select(by="o_orderpriority", order_count=agg.count())


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum(CASE WHEN n2.n_name = 'NATION_2' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share
  FROM lineitem JOIN part ON p_partkey = l_partkey AND p_type = 'ECONOMY' JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON n1.n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n1.n_regionkey AND r_name = 'AMERICA' JOIN supplier ON s_suppkey = l_suppkey JOIN nation n2 ON n2.n_nationkey = s_nationkey GROUP BY 1""")
def q08_market_share(t: Tables):
    n = t.nation.join(t.region.filter(L("r_name") == "AMERICA"), {"n_regionkey": "r_regionkey"}, "semi").select("n_nationkey")
    c = t.customer.select("c_custkey", "c_nationkey").join(n, {"c_nationkey": "n_nationkey"}, "semi").select("c_custkey")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(c, {"o_custkey": "c_custkey"}, "semi").select("o_orderkey", "o_orderdate")
    s = t.supplier.select("s_suppkey", "s_nationkey").join(t.nation.select("n_nationkey", "n_name"), {"s_nationkey": "n_nationkey"}).select("s_suppkey", "n_name")
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount").join(t.part.filter(L("p_type") == "ECONOMY").select("p_partkey"), {"l_partkey": "p_partkey"}, "semi")
    rows = li.join(o, {"l_orderkey": "o_orderkey"}).join(s, {"l_suppkey": "s_suppkey"})
    share = agg.sum(F.when(L("n_name") == "NATION_2", net()).otherwise(0.0)) / agg.sum(net())
    return rows.select(by={"o_year": F.year("o_orderdate").cast("long")}, mkt_share=share.map(lambda x: F.round(x, 6)))


@query("""SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity), 4) AS sum_profit
  FROM lineitem JOIN part ON p_partkey = l_partkey AND p_name LIKE '%ring%' JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def q09_product_profit(t: Tables):
    p = t.part.filter(L("p_name").like("%ring%")).select("p_partkey", "p_retailprice")
    s = t.supplier.select("s_suppkey", "s_nationkey").join(t.nation.select("n_nationkey", "n_name"), {"s_nationkey": "n_nationkey"}).select("s_suppkey", nation=L("n_name"))
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").join(p, {"l_partkey": "p_partkey"}).join(s, {"l_suppkey": "s_suppkey"})
    rows = li.join(t.orders.select("o_orderkey", "o_orderdate"), {"l_orderkey": "o_orderkey"})
    return rows.select(by={"nation": L("nation"), "o_year": F.year("o_orderdate").cast("long")}, sum_profit=r4(agg.sum(net() - L("p_retailprice") * L("l_quantity"))))


@query("""WITH v AS (SELECT l_partkey, sum(l_extendedprice) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = 1 GROUP BY 1)
  SELECT l_partkey AS p_partkey, round(value, 4) AS value FROM v WHERE value > 0.001 * (SELECT sum(value) FROM v)""")
def q11_important_stock(t: Tables):
    s = t.supplier.select("s_suppkey", "s_nationkey").join(t.nation.filter(L("n_regionkey") == 1).select("n_nationkey"), {"s_nationkey": "n_nationkey"}, "semi").select("s_suppkey")
    per = t.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice").join(s, {"l_suppkey": "s_suppkey"}, "semi").select(by="l_partkey", value=agg.sum("l_extendedprice"))
    rows = with_scalar(per.df, per.select(total=agg.sum("value")).df, "total", "total").where("value > 0.001 * total")
    return rows.select(L("l_partkey").alias("p_partkey"), F.round("value", 4).alias("value"))


@query("""SELECT l_linestatus, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_count, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_count
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND o_orderdate < l_shipdate AND l_quantity < 30 GROUP BY 1""")
def q12_late_lines_by_priority(t: Tables):
    li = t.lineitem.filter((L("l_shipdate") >= "1997-01-01") & (L("l_shipdate") < "1999-01-01") & (L("l_quantity") < 30)).select("l_orderkey", "l_linestatus", "l_shipdate")
    rows = li.join(t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority"), {"l_orderkey": "o_orderkey"}).filter(L("o_orderdate") < L("l_shipdate"))
    high = L("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return rows.select(by="l_linestatus", high_count=agg.count(F.when(high, 1)), low_count=agg.count(F.when(~high, 1)))


@query("""SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority <> '1-URGENT' GROUP BY 1) GROUP BY 1""")
def q13_order_counts(t: Tables):
    # counting orders before the join sends one row a customer through it
    per = t.orders.filter(L("o_orderpriority") != "1-URGENT").select(by="o_custkey", n=agg.count())
    each = t.customer.select("c_custkey").join(per, {"c_custkey": "o_custkey"}, "left").select("c_custkey", c_count=F.coalesce("n", F.lit(0)))
    return each.select(by="c_count", custdist=agg.count())


@query("""SELECT s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = 0 WHERE s_suppkey IN
  (SELECT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey AND p_name LIKE 'red%' WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_partkey, l_suppkey HAVING sum(l_quantity) > 45)""")
def q20_suppliers_of_many(t: Tables):
    p = t.part.filter(L("p_name").like("red%")).select("p_partkey")
    li = t.lineitem.filter((L("l_shipdate") >= "1997-01-01") & (L("l_shipdate") < "1998-01-01")).select("l_partkey", "l_suppkey", "l_quantity").join(p, {"l_partkey": "p_partkey"}, "semi")
    many = li.select(by=["l_partkey", "l_suppkey"], q=agg.sum("l_quantity")).filter(L("q") > 45)
    s = t.supplier.join(t.nation.filter(L("n_regionkey") == 0), {"s_nationkey": "n_nationkey"}, "semi")
    return s.join(many, {"s_suppkey": "l_suppkey"}, "semi").select("s_name")


@query("""WITH l AS (SELECT l_orderkey, l_suppkey, l_shipdate > o_orderdate AS late FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F')
  SELECT s_name, count(*) AS numwait FROM supplier JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = 4 JOIN l ON l_suppkey = s_suppkey AND late
  WHERE EXISTS (SELECT 1 FROM l o WHERE o.l_orderkey = l.l_orderkey AND o.l_suppkey <> l.l_suppkey) AND NOT EXISTS (SELECT 1 FROM l o WHERE o.l_orderkey = l.l_orderkey AND o.l_suppkey <> l.l_suppkey AND o.late) GROUP BY 1""")
def q21_waiting_suppliers(t: Tables):
    o = t.orders.filter(L("o_orderstatus") == "F").select("o_orderkey", "o_orderdate")
    li = Frame(spread(t.df("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate"), "l_orderkey")).join(o, {"l_orderkey": "o_orderkey"})
    # a row an order: it has several suppliers if the least differs from the greatest, one late one if those are the same
    late = F.when(L("l_shipdate") > L("o_orderdate"), L("l_suppkey"))
    each = li.select(by="l_orderkey", least=agg.min("l_suppkey"), most=agg.max("l_suppkey"), l_suppkey=agg.min(late), last_late=agg.max(late), n=agg.count(late))
    alone = each.filter((L("least") < L("most")) & (L("l_suppkey") == L("last_late")))
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey").join(t.nation.filter(L("n_regionkey") == 4), {"s_nationkey": "n_nationkey"}, "semi")
    return alone.join(s.select("s_suppkey", "s_name"), {"l_suppkey": "s_suppkey"}).select(by="s_name", numwait=agg.sum("n"))
