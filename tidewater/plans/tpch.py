"""Queries in the shape of well-known order-processing ones, on the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as agg
from .registry import Tables, query, r6

L = F.col


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS sum_charge,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def q01_pricing_summary(t: Tables):
    net = L("l_extendedprice") * (1 - L("l_discount"))
    r4 = lambda e: e.map(lambda x: F.round(x, 4))
    return t.lineitem.filter(L("l_shipdate") <= "1998-09-02").select(
        by=["l_returnflag", "l_linestatus"], sum_qty=r4(agg.sum("l_quantity")), sum_base_price=r4(agg.sum("l_extendedprice")), sum_disc_price=r4(agg.sum(net)), sum_charge=r4(agg.sum(net * (1 + L("l_tax")))),
        avg_qty=r6(agg.mean("l_quantity")), avg_price=r6(agg.mean("l_extendedprice")), avg_disc=r6(agg.mean("l_discount")), count_order=agg.count(),
    )


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer
  JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
  GROUP BY l_orderkey, o_orderdate ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, o_orderdate LIMIT 10""")
def q03_shipping_priority(t: Tables):
    c = t.customer.filter(L("c_mktsegment") == "BUILDING").select("c_custkey")
    o = t.orders.filter(L("o_orderdate") < "1995-03-15").select("o_orderkey", "o_custkey", "o_orderdate")
    li = t.lineitem.filter(L("l_shipdate") > "1995-03-15").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = li.join(o.join(c, {"o_custkey": "c_custkey"}, "semi"), {"l_orderkey": "o_orderkey"})
    out = joined.select(by=["l_orderkey", "o_orderdate"], revenue=agg.sum(L("l_extendedprice") * (1 - L("l_discount"))))
    return out.head(10, order=[("revenue", "desc"), "o_orderdate"]).select("l_orderkey", "o_orderdate", revenue=F.round("revenue", 4))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1995-01-01' GROUP BY n_name""")
def q05_local_supplier(t: Tables):
    n = t.nation.join(t.region.filter(L("r_name") == "ASIA"), {"n_regionkey": "r_regionkey"}, "semi").select("n_nationkey", "n_name")
    s = t.supplier.select("s_suppkey", "s_nationkey").join(n, {"s_nationkey": "n_nationkey"})
    o = t.orders.filter((L("o_orderdate") >= "1994-01-01") & (L("o_orderdate") < "1995-01-01")).select("o_orderkey", "o_custkey")
    o = o.join(t.customer.select("c_custkey", "c_nationkey"), {"o_custkey": "c_custkey"})
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(o, {"l_orderkey": "o_orderkey"})
    joined = li.join(s, {"l_suppkey": "s_suppkey", "c_nationkey": "s_nationkey"})
    return joined.select(by=["n_name"], revenue=agg.sum(L("l_extendedprice") * (1 - L("l_discount"))).map(lambda x: F.round(x, 4)))


@query("""SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01'
  AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def q06_revenue(t: Tables):
    e = (L("l_shipdate") >= "1994-01-01") & (L("l_shipdate") < "1995-01-01") & L("l_discount").between(0.05, 0.07) & (L("l_quantity") < 24)
    return t.lineitem.filter(e).select(revenue=agg.sum(L("l_extendedprice") * L("l_discount")).map(lambda x: F.round(x, 4)))


@query("""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
  WHERE n1.n_regionkey = 2 AND n2.n_regionkey = 3 GROUP BY ALL""")
def q07_volume_shipping(t: Tables):
    n1 = t.nation.filter(L("n_regionkey") == 2).select("n_nationkey", supp_nation=L("n_name"))
    n2 = t.nation.filter(L("n_regionkey") == 3).select("n_nationkey", cust_nation=L("n_name"))
    s = t.supplier.select("s_suppkey", "s_nationkey").join(n1, {"s_nationkey": "n_nationkey"}).select("s_suppkey", "supp_nation")
    c = t.customer.select("c_custkey", "c_nationkey").join(n2, {"c_nationkey": "n_nationkey"}).select("c_custkey", "cust_nation")
    o = t.orders.select("o_orderkey", "o_custkey").join(c, {"o_custkey": "c_custkey"}).select("o_orderkey", "cust_nation")
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount").join(s, {"l_suppkey": "s_suppkey"}).join(o, {"l_orderkey": "o_orderkey"})
    return li.select(by={"supp_nation": L("supp_nation"), "cust_nation": L("cust_nation"), "l_year": F.year("l_shipdate").cast("long")}, revenue=agg.sum(L("l_extendedprice") * (1 - L("l_discount"))).map(lambda x: F.round(x, 4)))


@query("""SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderdate >= TIMESTAMP '1993-10-01' AND o_orderdate < TIMESTAMP '1994-01-01' AND l_returnflag = 'R'
  GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC LIMIT 20""")
def q10_returned_items(t: Tables):
    o = t.orders.filter((L("o_orderdate") >= "1993-10-01") & (L("o_orderdate") < "1994-01-01")).select("o_orderkey", "o_custkey")
    li = t.lineitem.filter(L("l_returnflag") == "R").select("l_orderkey", "l_extendedprice", "l_discount").join(o, {"l_orderkey": "o_orderkey"})
    per = li.select(by=["o_custkey"], revenue=agg.sum(L("l_extendedprice") * (1 - L("l_discount")))).head(20, order=[("revenue", "desc")])
    c = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    full = per.join(c, {"o_custkey": "c_custkey"}).join(t.nation.select("n_nationkey", "n_name"), {"c_nationkey": "n_nationkey"})
    return full.select("c_custkey", "c_name", "c_acctbal", "n_name", revenue=F.round("revenue", 4))


@query("""SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'""")
def q14_promotion(t: Tables):
    li = t.lineitem.filter((L("l_shipdate") >= "1995-09-01") & (L("l_shipdate") < "1995-10-01")).select("l_partkey", "l_extendedprice", "l_discount")
    net = L("l_extendedprice") * (1 - L("l_discount"))
    joined = li.join(t.part.select("p_partkey", "p_type"), {"l_partkey": "p_partkey"})
    return joined.select(promo_revenue=r6(100.0 * agg.sum(F.when(L("p_type").like("PROMO%"), net).otherwise(0.0)) / agg.sum(net)))


@query("""WITH r AS (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY 1)
  SELECT s_suppkey, s_name, round(total, 4) AS total_revenue FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM r)""")
def q15_top_supplier(t: Tables):
    from ..operators.joins import with_scalar

    li = t.lineitem.filter((L("l_shipdate") >= "1996-01-01") & (L("l_shipdate") < "1996-04-01"))
    per = li.select(by=["l_suppkey"], total=agg.sum(L("l_extendedprice") * (1 - L("l_discount"))).map(lambda x: F.round(x, 4)))
    top = with_scalar(per.df, per.select(m=agg.max("total")).df, "m", "best").where("total = best")
    return top.join(t.supplier.df, L("l_suppkey") == L("s_suppkey")).select("s_suppkey", "s_name", L("total").alias("total_revenue"))


@query("""SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE p_brand <> 'Brand#45' AND p_size IN (1, 4, 7, 9, 14, 19, 23, 45, 49) GROUP BY ALL""")
def q16_supplier_count(t: Tables):
    p = t.part.filter((L("p_brand") != "Brand#45") & L("p_size").isin(1, 4, 7, 9, 14, 19, 23, 45, 49)).select("p_partkey", "p_brand", "p_type", "p_size")
    once = t.lineitem.select("l_partkey", "l_suppkey").join(p, {"l_partkey": "p_partkey"}).distinct("p_brand", "p_type", "p_size", "l_suppkey")
    return once.select(by=["p_brand", "p_type", "p_size"], supplier_cnt=agg.count())


@query("""SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem l JOIN part ON p_partkey = l.l_partkey
  WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.8 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""")
def q17_small_quantity(t: Tables):
    p = t.part.filter(L("p_brand") == "Brand#23").select("p_partkey")
    li = t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice").join(p, {"l_partkey": "p_partkey"}, "semi")
    near = li.update(by="l_partkey", least=0.8 * agg.mean("l_quantity")).filter(L("l_quantity") < L("least"))
    return near.select(avg_yearly=agg.sum("l_extendedprice").map(lambda x: F.round(x / 7.0, 4)))


@query("""SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 4) AS sum_qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 250) GROUP BY ALL""")
def q18_large_orders(t: Tables):
    big = t.lineitem.select(by=["l_orderkey"], q=agg.sum("l_quantity")).filter(L("q") > 250)
    o = t.orders.join(big.select("l_orderkey", sum_qty=F.round("q", 4)), {"o_orderkey": "l_orderkey"})
    return o.join(t.customer.select("c_custkey", "c_name"), {"o_custkey": "c_custkey"}).select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "sum_qty")


@query("""SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
  OR (p_brand = 'Brand#34' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""")
def q19_discounted(t: Tables):
    j = t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice", "l_discount").join(t.part.select("p_partkey", "p_brand", "p_size"), {"l_partkey": "p_partkey"})
    one = lambda b, lo, hi, s: (L("p_brand") == b) & L("l_quantity").between(lo, hi) & L("p_size").between(1, s)
    return j.filter(one("Brand#12", 1, 11, 5) | one("Brand#23", 10, 20, 10) | one("Brand#34", 20, 30, 15)).select(revenue=agg.sum(L("l_extendedprice") * (1 - L("l_discount"))).map(lambda x: F.round(x, 4)))


@query("""SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 4) AS totacctbal FROM customer
  WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY ALL""")
def q22_idle_customers(t: Tables):
    from ..operators.joins import with_scalar

    mean = t.customer.filter(L("c_acctbal") > 0).select(m=agg.mean("c_acctbal")).df
    rich = t.customer._as(with_scalar(t.customer.df, mean, "m", "m").where("c_acctbal > m"))
    idle = rich.join(t.orders.filter(L("o_totalprice") > 400000).select("o_custkey"), {"c_custkey": "o_custkey"}, "anti")
    return idle.select(by=["c_mktsegment"], numcust=agg.count(), totacctbal=agg.sum("c_acctbal").map(lambda x: F.round(x, 4)))
