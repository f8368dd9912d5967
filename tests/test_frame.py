"""Edge semantics on tiny frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewater import Frame, as_timeframe, rbind
from tidewater.functions import aggregates as agg
from tidewater.functions import durations
from tidewater.functions import scalars as sc
from tidewater.functions import windows as win
from tidewater.operators import joins, models, reshape

C = F.col


def values(frame, *columns):
    df = frame.df if isinstance(frame, Frame) else frame
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def ticks(spark):
    rows = [(i, "A" if i % 2 else "B", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "n long, sym string, px double").withColumn("ts", F.timestamp_seconds("n"))
    return as_timeframe(Frame(df).ordered("ts"), "ts")


def test_null_group_keys_are_one_group(spark):
    f = Frame(spark.createDataFrame([(0, 1), (None, 2), (None, 3)], "k int, v int"))
    assert values(f.select(by="k", s=agg.sum("v")), "k", "s") == [(0, 1), (None, 5)]


def test_division_and_remainder(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(sc.div("a", "b")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 1.5 and got[4] is None
    assert [r[0] for r in spark.createDataFrame([(7, 0), (7, 3), (-7, 3)], "a long, b long").select(sc.mod("a", "b")).collect()] == [0, 1, -1]


def test_logs_follow_ieee(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "x double").select(sc.log("x")).collect()]
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2] == 0


def test_round_modes(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (3.5,)], "x double")
    assert [tuple(r) for r in df.select(sc.round_("x"), sc.round_("x", "bankers"), sc.round_("x", "floor"), sc.round_("x", "ceil"), sc.round_("x", "trunc")).collect()] == [(3, 2, 2, 3, 2), (-3, -2, -3, -2, -2), (4, 4, 3, 4, 3)]


def test_checked_cast_refuses_fractions(spark):
    assert spark.createDataFrame([(3.0,)], "x double").select(sc.to_int("x")).first()[0] == 3
    with pytest.raises(Exception, match="whole number"):
        spark.createDataFrame([(3.9,)], "x double").select(sc.to_int("x")).collect()


def test_substring_counts_from_zero_and_clamps(spark):
    df = spark.createDataFrame([("abc",)], "s string")
    assert tuple(df.select(sc.substring("s", 1), sc.substring("s", -5, 3), sc.substring("s", 9), sc.substring("s", -2, 1)).first()) == ("bc", "abc", "", "b")


def test_like_takes_any_escape(spark):
    df = spark.createDataFrame([("a%c",), ("abc",), ("a\nc",)], "s string")
    assert [r[0] for r in df.select(sc.like("s", r"a\%c")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(sc.like("s", "a_c")).collect()] == [True, True, True]


def test_interpolation_is_null_with_a_null(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert [r[0] for r in df.select(sc.interp("n=", C("x"))).collect()] == ["n=1", None]


def test_update_sees_the_input(spark):
    f = Frame(spark.createDataFrame([(1, 2)], "a int, b int"))
    assert values(f.update(a=C("b"), b=C("a")), "a", "b") == [(2, 1)]


def test_shape_aggregates_of_few_values(spark):
    f = Frame(spark.createDataFrame([(1.0,), (2.0,)], "x double"))
    assert values(f.select(a=agg.skew("x"), b=agg.kurtosis("x"), c=agg.std("x")), "a", "b") == [(None, None)]
    g = Frame(spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,)], "x double"))
    assert values(g.select(a=agg.skew("x"), b=agg.kurtosis("x")), "a", "b") == [(0.0, 0.0)]
    h = Frame(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double"))
    a, b, q = values(h.select(a=agg.skew("x"), b=agg.kurtosis("x"), q=agg.quantile("x", 0.3)), "a", "b", "q")[0]
    assert abs(a - 1.7636) < 1e-3 and abs(b - 3.2280) < 1e-3 and abs(q - 1.9) < 1e-9


def test_nested_aggregate_is_refused():
    with pytest.raises(ValueError, match="inside"):
        agg.sum(agg.mean("x"))


def test_order_dependent_without_order_is_refused(spark):
    f = Frame(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError, match="order"):
        f.update(y=win.lag("x"))


def test_per_call_windows(ticks):
    out = ticks.update(cw=win.rolling_mean("px", 3), dw=win.rolling_sum("px", "3s")).df.orderBy("ts")
    assert [r["cw"] for r in out.collect()][:4] == [0.0, 0.5, 1.0, 2.0]
    assert [r["dw"] for r in out.collect()][:5] == [0.0, 1.0, 3.0, 6.0, 9.0]


def test_sliding_window_is_open_on_the_left(ticks):
    out = ticks.window("3s", by="sym", update={"s": agg.sum("px")}).df.where("sym = 'A'").orderBy("ts")
    assert [r["s"] for r in out.collect()] == [1.0, 4.0, 8.0, 12.0, 16.0]


def test_ties_by_peers_and_by_position(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (0, 3, 4.0)], "s long, n long, x double").withColumn("ts", F.timestamp_seconds("s"))
    peers = as_timeframe(Frame(df).ordered("ts", "n"), "ts", ties="peers").window("1s", update={"v": agg.sum("x")})
    place = as_timeframe(Frame(df).ordered("ts", "n"), "ts").window("1s", update={"v": agg.sum("x")})
    assert values(peers, "n", "v") == [(1, 7.0), (2, 7.0), (3, 7.0)]
    assert values(place, "n", "v") == [(1, 1.0), (2, 3.0), (3, 7.0)]


def test_rolling_std_of_one_value_is_zero(ticks):
    assert ticks.update(s=win.rolling_std("px", 1)).df.agg(F.max("s")).first()[0] == 0.0


def test_nanosecond_index(spark):
    f = as_timeframe(Frame(spark.createDataFrame([(i * 10**9, float(i)) for i in range(4)], "ts long, x double")), "ts")
    assert [r[1] for r in values(f.window("2s", update={"s": agg.sum("x")}), "ts", "s")] == [0.0, 1.0, 3.0, 5.0]
    assert values(f.resample("2s", n=agg.count()), "ts", "n") == [(0, 2), (2 * 10**9, 2)]


def test_durations():
    assert durations.nanos("1h30m") == 5400 * 10**9 and durations.ticks("2mo", "date") == 60
    with pytest.raises(ValueError):
        durations.nanos("5 parsecs")
    with pytest.raises(ValueError):
        durations.ticks("10ns", "timestamp")


def test_join_collisions_nulls_and_cardinality(spark):
    a = Frame(spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string"))
    b = Frame(spark.createDataFrame([(1, "p"), (1, "q"), (None, "r")], "k int, v string")).ordered("v")
    with pytest.raises(ValueError, match="suffix"):
        a.join(b, "k")
    assert len(values(a.join(b, "k", suffix=("", "_r")), "k")) == 2
    assert len(values(a.join(b, "k", suffix=("", "_r"), nulls="equal"), "k")) == 3
    assert values(a.join(b, "k", "left", suffix=("", "_r"), take="last"), "v", "v_r") == [("x", "q"), ("y", None)]
    with pytest.raises(Exception, match="not n:1"):
        a.join(b, "k", suffix=("", "_r"), expect="n:1").df.collect()
    assert values(a.join(b, "k", "anti"), "v") == [("y",)] and values(a.join(b, "k", "semi"), "v") == [("x",)]


def test_take_drops_losers_instead_of_keeping_them(spark):
    a = Frame(spark.createDataFrame([(1,)], "k int"))
    b = Frame(spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, v string")).ordered("v")
    assert values(a.join(b, "k", "outer", take="first"), "k", "v") == [(1, "p"), (2, "r")]


def test_asof_takes_the_last_tied_row_and_ignores_null_keys(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    left = as_timeframe(Frame(spark.createDataFrame([(t(5), "a", 1), (t(1), "b", 2), (t(5), None, 3)], "ts timestamp, k string, i int")), "ts")
    right = spark.createDataFrame([(t(4), "a", 1, 10.0), (t(4), "a", 2, 20.0), (t(6), "a", 3, 30.0), (t(0), None, 4, 40.0)], "ts timestamp, k string, seq int, q double")
    out = left.asof(as_timeframe(Frame(right).ordered("seq"), "ts"), by=["k"])
    assert values(out, "i", "q") == [(1, 20.0), (2, None), (3, None)]
    near = joins.asof(left.df, right.drop("seq"), "ts", ["k"], tolerance="500ms")
    assert values(near, "i", "q") == [(1, None), (2, None), (3, None)]


def test_block_clause_rules(spark):
    f = Frame(spark.createDataFrame([(1, 2)], "a int, b int"))
    for bad in ({"select": ["a"], "update": {"a": C("b")}}, {"head": 1, "tail": 1}, {"by": ["a"]}, {"melt": ["a"], "dcast": "b"}, {"cov": True, "select": ["a"]}, {"where": C("a") > 0, "select": ["a"]}):
        with pytest.raises(ValueError):
            f.block(**bad)


def test_head_refuses_negative(spark):
    with pytest.raises(ValueError):
        Frame(spark.range(3)).head(-1)


def test_dcast_last_row_wins_and_null_pivot_is_skipped(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1), (1, "a", 2.0, 2), (1, None, 9.0, 3), (2, "b", 5.0, 4)], "id int, m string, v double, n int")
    out = Frame(df).ordered("n").dcast("m", "v", ["id"])
    assert out.df.columns == ["id", "a", "b"] and values(out, "id", "a", "b") == [(1, 2.0, None), (2, None, 5.0)]


def test_melt_keeps_nulls_and_wants_one_type(spark):
    f = Frame(spark.createDataFrame([(1, None, 2.0)], "id int, a double, b double"))
    assert values(f.melt("id"), "variable", "value") == [("a", None), ("b", 2.0)]
    with pytest.raises(ValueError):
        Frame(spark.createDataFrame([(1, "x", 2.0)], "id int, a string, b double")).melt("id")


def test_transpose_without_labels(spark):
    f = Frame(spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")).ordered("a")
    assert values(f.transpose(), "column", "r0", "r1") == [("a", 1.0, 3.0), ("b", 2.0, 4.0)]


def test_rbind_needs_equal_columns(spark):
    with pytest.raises(ValueError):
        rbind(Frame(spark.range(1)), Frame(spark.range(1).toDF("x")))


def test_ascription(spark):
    f = Frame(spark.createDataFrame([(1, "x")], "a int, b string"))
    assert f.ascribe("a int") is f
    with pytest.raises(TypeError):
        f.ascribe("a string")


def test_formula_dummies_interactions_and_no_intercept(spark):
    rows = [(float(i), float(i % 3), "uvw"[i % 3], 2.0 + 3 * i + 5 * (i % 3) + (7 if i % 3 == 1 else 0)) for i in range(12)]
    df = spark.createDataFrame(rows, "a double, b double, g string, y double")
    m = models.fit(df, "y ~ a + g")
    coef = {r["term"]: r["estimate"] for r in m.coef().collect()}
    assert set(coef) == {"(Intercept)", "a", "gv", "gw"} and abs(coef["a"] - 3) < 1e-8 and abs(coef["gv"] - 12) < 1e-8
    assert abs(m.r_squared - 1) < 1e-9 and m.residuals().agg(F.max(F.abs("residual"))).first()[0] < 1e-6
    assert models.parse_formula("y ~ a*b - 1", df.columns).terms == [("a",), ("b",), ("a", "b")]
    assert not models.parse_formula("y ~ a - 1", df.columns).intercept


def test_scalar_needs_one_row(spark):
    assert joins.scalar(spark.createDataFrame([(5,)], "x int"), "x") == 5
    with pytest.raises(ValueError):
        joins.scalar(spark.createDataFrame([(5,), (6,)], "x int"), "x")


def test_rep(spark):
    df = reshape.table(spark, {"n": [0, 1, 2, 3]}, schema="n long")
    assert values(reshape.rep(df, "r", "n", ["n"], each=2), "n", "r") == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_wall_clock_gaps_and_overlaps(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-11-03 01:30:00",), ("2024-07-01 12:00:00",)], "s string").select(C("s").cast("timestamp_ntz").alias("t"))
    got = [r[0] for r in df.select(sc.with_timezone("t", "America/New_York").cast("string")).collect()]
    assert got == [None, "2024-11-03 05:30:00", "2024-07-01 16:00:00"]
