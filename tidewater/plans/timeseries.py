"""Queries on windows, ranks, resampling and time zones."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..frame import as_timeframe, in_timezone
from ..functions import aggregates as agg
from ..functions import scalars as sc
from ..functions import windows as win
from .registry import Tables, query, r6

C = F.col
#: As the SQL of RANGE frames has it, rows of equal time see each other.
SIX = "RANGE BETWEEN INTERVAL '5 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW"


def _events_as_peers(t: Tables):
    return replace(t.events.select("event_id", "ts", "event_type", "value"), ties="peers")


@query(f"SELECT event_id, round(sum(value) OVER w, 6) AS s, round(avg(value) OVER w, 6) AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts {SIX})")
def roll_sum_mean_sliding(t: Tables):
    return _events_as_peers(t).window("6h", by="event_type", update={"s": r6(agg.sum("value")), "m": r6(agg.mean("value")), "n": agg.count()}).select("event_id", "s", "m", "n")


@query(f"SELECT event_id, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts {SIX})")
def roll_min_max(t: Tables):
    return _events_as_peers(t).window("6h", by="event_type", update={"lo": win.rolling_min("value"), "hi": win.rolling_max("value")}).select("event_id", "lo", "hi")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 19 PRECEDING), 6) AS m20 FROM events")
def roll_count_window(t: Tables):
    return t.events.update(by="event_type", m20=r6(win.rolling_mean("value", 20))).select("event_id", "m20")


@query("""SELECT event_id, first(value) OVER w AS o, max(value) OVER w AS h, min(value) OVER w AS l, value AS c FROM events
  WINDOW w AS (PARTITION BY event_type, floor(epoch_us(ts) / 3600000000) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def roll_aligned_ohlc(t: Tables):
    f = {"event_id": C("event_id"), "o": win.rolling_first("value"), "h": agg.max("value"), "l": agg.min("value"), "c": win.rolling_last("value")}
    return t.events.window("1h", aligned=True, by="event_type", select=f).select("event_id", "o", "h", "l", "c")


@query(f"SELECT event_id, round(median(value) OVER w, 6) AS med, round(quantile_cont(value, 0.75) OVER w, 6) AS q FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts {SIX})")
def roll_median_quantile(t: Tables):
    return _events_as_peers(t).window("6h", by="event_type", update={"med": r6(win.rolling_median("value")), "q": r6(win.rolling_quantile("value", 0.75))}).select("event_id", "med", "q")


@query(f"SELECT event_id, round(coalesce(stddev_samp(value) OVER w, 0), 5) AS sd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts {SIX})")
def roll_std(t: Tables):
    return _events_as_peers(t).window("6h", by="event_type", update={"sd": win.rolling_std("value").map(lambda x: F.round(x, 5))}).select("event_id", "sd")


@query("""SELECT event_id, round(CASE WHEN n < 3 THEN 0 ELSE sk END, 4) AS sk, round(CASE WHEN n < 4 THEN 0 ELSE ku END, 4) AS ku FROM
  (SELECT event_id, count(*) OVER w AS n, skewness(value) OVER w AS sk, kurtosis(value) OVER w AS ku FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 29 PRECEDING))""")
def roll_skew_kurt(t: Tables):
    r4 = lambda e: e.map(lambda x: F.round(x, 4))
    return t.events.update(by="event_type", sk=r4(win.rolling_skew("value", 30)), ku=r4(win.rolling_kurtosis("value", 30))).select("event_id", "sk", "ku")


@query("SELECT event_id, round(list_reduce(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 9 PRECEDING), lambda s, x: 0.3 * x + 0.7 * s), 6) AS e FROM events")
def roll_ewma(t: Tables):
    return t.events.update(by="event_type", e=r6(win.rolling_ewma("value", 0.3, 10))).select("event_id", "e")


@query("SELECT event_id, first(value) OVER w AS f, last(value) OVER w AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)")
def roll_first_last(t: Tables):
    return t.events.update(by="user_id", f=win.rolling_first("value", 5), l=win.rolling_last("value", 5)).select("event_id", "f", "l")


@query("""SELECT event_id, make_timestamp(CAST(floor(epoch_us(ts) / 21600000000) AS BIGINT) * 21600000000) AS a, make_timestamp((CAST(floor(epoch_us(ts) / 21600000000) AS BIGINT) + 1) * 21600000000) AS b FROM events""")
def window_bounds(t: Tables):
    out = t.events.window("6h", aligned=True, update={"a": win.window_start(), "b": win.window_end()})
    return out.select("event_id", a=C("a").cast("timestamp_ntz"), b=C("b").cast("timestamp_ntz"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS s FROM events""")
def roll_ties_by_position(t: Tables):
    """All events of a day share a time here; only earlier rows count."""
    day = replace(t.events.update(ts=F.lit("2020-01-01").cast("timestamp")), ties="position", order_by=("seq",))
    day = replace(day, df=t.events.update(seq=F.struct("ts", "event_id")).df.withColumn("ts", F.lit("2020-01-01").cast("timestamp")))
    return day.window("1d", by="user_id", update={"s": r6(agg.sum("value"))}).select("event_id", "s")


@query("SELECT event_id, lag(value, 1) OVER w AS a, lead(value, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(t: Tables):
    return t.events.update(by="user_id", a=win.lag("value"), b=win.lead("value", 2)).select("event_id", "a", "b")


@query("""SELECT event_id, round(sum(value) OVER w, 6) AS s, round(product(1 + value / 1000000) OVER w, 8) AS p FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def cumsum_cumprod(t: Tables):
    return t.events.update(by="user_id", s=r6(win.cumsum("value")), p=win.cumprod(1 + C("value") / 1000000).map(lambda x: F.round(x, 8))).select("event_id", "s", "p")


@query("""SELECT event_id, last(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f,
  first(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)""")
def fill_forward_backward(t: Tables):
    v = F.when(C("event_id") % 3 != 0, C("value"))
    return t.events.update(by="user_id", f=win.fill_forward(v), b=win.fill_backward(v)).select("event_id", "f", "b")


@query("""SELECT event_id, rank() OVER w AS mn, rank() OVER w + p - 1 AS mx, rank() OVER w + (p - 1) / 2.0 AS av, dense_rank() OVER w AS de, row_number() OVER (PARTITION BY event_type ORDER BY k, ts, event_id) AS fi
  FROM (SELECT *, count(*) OVER (PARTITION BY event_type, k) AS p FROM (SELECT *, floor(value / 10) AS k FROM events)) WINDOW w AS (PARTITION BY event_type ORDER BY k)""")
def rank_methods(t: Tables):
    k = F.floor(C("value") / 10)
    return t.events.update(by="event_type", mn=win.rank(k, "min", na_option="bottom"), mx=win.rank(k, "max", na_option="bottom"), av=win.rank(k, na_option="bottom"), de=win.rank(k, "dense", na_option="bottom"), fi=win.rank(k, "first", na_option="bottom")).select("event_id", "mn", "mx", "av", "de", "fi")


@query("""SELECT event_id, CASE WHEN v IS NOT NULL THEN round(rank() OVER (PARTITION BY event_type, v IS NULL ORDER BY v DESC) * 1.0 / count(*) OVER (PARTITION BY event_type, v IS NULL), 9) END AS keep,
  rank() OVER (PARTITION BY event_type ORDER BY v NULLS FIRST) AS top, rank() OVER (PARTITION BY event_type ORDER BY v NULLS LAST) AS bottom
  FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events)""")
def rank_pct_na_option(t: Tables):
    v = F.when(C("event_id") % 4 != 0, C("value"))
    keep = win.rank(v, "min", ascending=False, pct=True).map(lambda x: F.round(x, 9))
    return t.events.update(by="event_type", keep=keep, top=win.rank(v, "min", na_option="top"), bottom=win.rank(v, "min", na_option="bottom")).select("event_id", "keep", "top", "bottom")


@query("SELECT event_id, row_number() OVER (ORDER BY event_type DESC, value, ts, event_id) AS r FROM events")
def rank_multi_key(t: Tables):
    return t.events.update(r=win.rank([("event_type", False), ("value", True)], "first", na_option="bottom")).select("event_id", "r")


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS ts, event_type, first(value ORDER BY ts, event_id) AS o, max(value) AS h, min(value) AS l, last(value ORDER BY ts, event_id) AS c FROM events GROUP BY 1, 2""")
def resample_ohlc(t: Tables):
    return t.events.resample("1d", by="event_type", o=agg.first("value"), h=agg.max("value"), l=agg.min("value"), c=agg.last("value"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS ts, round(sum(value * event_id) / sum(event_id + 1), 6) AS vwap FROM events GROUP BY 1")
def resample_vwap(t: Tables):
    return t.events.resample("6h", vwap=r6(agg.sum(C("value") * C("event_id")) / agg.sum(C("event_id") + 1)))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS ts, user_id, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, ts, user_id LIMIT 30")
def resample_by_then_order(t: Tables):
    return t.events.resample("1d", by="user_id", n=agg.count()).head(30, order=[("n", "desc"), "ts", "user_id"])


@query("""SELECT (date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo') - INTERVAL 9 HOUR)::TIMESTAMP AS ts, count(*) AS n, round(sum(value), 6) AS s FROM events GROUP BY 1""")
def resample_zoned(t: Tables):
    return in_timezone(t.events, "Asia/Tokyo").resample("1d", n=agg.count(), s=r6(agg.sum("value")))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def date_cast_group(t: Tables):
    return t.events.select(by={"day": sc.to_date("ts")}, n=agg.count())


@query("""SELECT day, CAST(sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS n3 FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)""")
def window_over_dates(t: Tables):
    days = as_timeframe(t.events.select(by={"day": sc.to_date("ts")}, n=agg.count()), "day")
    return days.window("3d", update={"n3": r6(agg.sum("n"))}).select("day", "n3")


@query("SELECT event_id, ts - INTERVAL 9 HOUR AS instant FROM events")
def timezone_wall_clock(t: Tables):
    return t.events.select("event_id", instant=sc.with_timezone("ts", "Asia/Tokyo").cast("timestamp_ntz"))
