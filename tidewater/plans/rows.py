"""Queries on filters, projections, order, grouping and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import windows as win
from .registry import Tables, query, r6

C = F.col


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'F') OR o_orderpriority = '1-URGENT'")
def filter_and_or(t: Tables):
    return t.orders.filter(((C("o_totalprice") > 100000) & (C("o_orderstatus") == "F")) | (C("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_totalprice")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT (l.quality = 1 AND d.n_chars > 500)")
def filter_3vl(t: Tables):
    j = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.filter(~((C("quality") == 1) & (C("n_chars") > 500))).select("doc_id", "quality")


@query("SELECT event_id, value FROM (SELECT *, lag(value) OVER (ORDER BY ts, event_id) AS p FROM events) WHERE value > p")
def filter_lag(t: Tables):
    return t.events.filter(win.lag("value").map(lambda x: C("value") > x)).select("event_id", "value")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, l_quantity * 2 AS twice FROM lineitem")
def select_computed(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", net=r6(C("l_extendedprice") * (1 - C("l_discount"))), twice=C("l_quantity") * 2)


@query("SELECT p_partkey, p_size * 10 AS big_p_size, p_retailprice * 10 AS big_p_retailprice FROM part")
def map_fields(t: Tables):
    return t.part.select("p_partkey", **{f"big_{c}": C(c) * 10 for c in ("p_size", "p_retailprice")})


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_multi(t: Tables):
    return t.lineitem.distinct("l_returnflag", "l_linestatus")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def rename_then_select(t: Tables):
    return t.orders.rename(id="o_orderkey", price="o_totalprice").select("id", "price")


@query("SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders) ORDER BY p ASC NULLS LAST, o_orderkey LIMIT 50")
def order_nulls_last_topk(t: Tables):
    return t.orders.select("o_orderkey", p=F.when(C("o_orderkey") % 7 != 0, C("o_totalprice"))).head(50, order=["p", "o_orderkey"])


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def head_by(t: Tables):
    return t.events.head(3, by="user_id", order=[("value", "desc"), "event_id"]).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 2")
def tail_by(t: Tables):
    return t.events.tail(2, by="user_id").select("user_id", "event_id")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def tail_global(t: Tables):
    return t.events.tail(25).select("event_id", "ts")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.5 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'cut' END AS note FROM orders")
def guarded_update(t: Tables):
    return t.orders.update(where=C("o_orderstatus") == "F", o_totalprice=C("o_totalprice") * 0.5, note=F.lit("cut")).select("o_orderkey", "o_totalprice", "note")


@query("SELECT p_partkey, CAST(p_size // 10 AS INTEGER) AS tens, CAST(p_size % 10 AS INTEGER) AS ones FROM part")
def tuple_update(t: Tables):
    return t.part.update_tuple(["tens", "ones"], lambda d: F.struct(F.expr("int(p_size div 10)"), F.expr("int(p_size % 10)"))).select("p_partkey", "tens", "ones")


@query("SELECT p_partkey, upper(p_brand) AS brand_up, CAST(length(p_name) AS INTEGER) AS name_len FROM part")
def merge_update(t: Tables):
    return t.part.update_merge(lambda d: F.struct(F.upper("p_brand").alias("brand_up"), F.char_length("p_name").alias("name_len"))).select("p_partkey", "brand_up", "name_len")


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS s, round(avg(value), 6) AS m, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def agg_basic(t: Tables):
    return t.events.select(by="event_type", n=agg.count(), s=r6(agg.sum("value")), m=r6(agg.mean("value")), lo=agg.min("value"), hi=agg.max("value"))


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1")
def agg_computed_key(t: Tables):
    return t.orders.select(by={"y": F.year("o_orderdate").cast("long")}, n=agg.count())


@query("SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) AS unit, round(0.2 * avg(l_quantity), 6) AS fifth FROM lineitem GROUP BY 1")
def agg_compound(t: Tables):
    return t.lineitem.select(by="l_returnflag", unit=r6(agg.sum("l_extendedprice") / agg.sum("l_quantity")), fifth=r6(0.2 * agg.mean("l_quantity")))


@query("""SELECT user_id, first(v ORDER BY ts, event_id) FILTER (v IS NOT NULL) AS f, last(v ORDER BY ts, event_id) FILTER (v IS NOT NULL) AS l
  FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events) GROUP BY 1""")
def agg_first_last(t: Tables):
    v = F.when(C("event_id") % 5 != 0, C("value"))
    return t.events.select(by="user_id", f=agg.first(v), l=agg.last(v))


@query("SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY 1")
def agg_median_quantile(t: Tables):
    return t.events.select(by="event_type", med=r6(agg.median("value")), q90=r6(agg.quantile("value", 0.9)))


@query("SELECT event_type, round(stddev_samp(value), 6) AS sd, round(skewness(value), 5) AS sk, round(kurtosis(value), 5) AS ku FROM events GROUP BY 1")
def agg_std_skew_kurt(t: Tables):
    r5 = lambda e: e.map(lambda x: F.round(x, 5))
    return t.events.select(by="event_type", sd=r6(agg.std("value")), sk=r5(agg.skew("value")), ku=r5(agg.kurtosis("value")))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda s, x: 0.3 * x + 0.7 * s), 6) AS e FROM events GROUP BY 1")
def agg_ewma(t: Tables):
    return t.events.select(by="user_id", e=r6(agg.ewma("value", 0.3)))


@query("SELECT d.source, count(*) AS n, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def agg_count_nonnull(t: Tables):
    j = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.select(by="source", n=agg.count(), labelled=agg.count("quality"))


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 6) AS away, count(*) OVER (PARTITION BY event_type) AS n FROM events")
def update_by_broadcast(t: Tables):
    return t.events.update(by="event_type", m=agg.mean("value"), n=agg.count()).select("event_id", "n", away=r6(C("value") - C("m")))


def weighted_mean(x, w):
    """An aggregate made of aggregates, as a user function."""
    return agg.sum(C(x) * C(w)) / agg.sum(w)


@query("SELECT l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS wm FROM lineitem GROUP BY 1")
def agg_udf_weighted_mean(t: Tables):
    return t.lineitem.select(by="l_linestatus", wm=r6(weighted_mean("l_extendedprice", "l_quantity")))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS k, count(*) AS n FROM documents GROUP BY 1")
def group_null_keys(t: Tables):
    return t.documents.select(by={"k": F.when(C("doc_id") % 3 != 0, C("source"))}, n=agg.count())


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS m FROM lineitem WHERE l_discount > 0.03 GROUP BY 1 ORDER BY 1 LIMIT 2")
def block_all_clauses(t: Tables):
    return t.lineitem.block(head=2, order=["l_returnflag"], select={"m": r6(agg.mean("l_quantity"))}, by=["l_returnflag"], filter=C("l_discount") > 0.03)
