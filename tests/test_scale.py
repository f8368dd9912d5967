"""Queries on tables that are denser, more tied or larger than the small ones, against their SQL, and what their plans may not hold."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import FOLDER, rows

from tidewater import Frame, as_timeframe
from tidewater.functions import windows as win
from tidewater.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """The small tables, events three times over at the same times, some values null."""
    out = str(tmp_path_factory.mktemp("tied"))
    for f in os.listdir(FOLDER):
        if f != "events.parquet":
            os.symlink(f"{FOLDER}/{f}", f"{out}/{f}")
    value = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value + i END"
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + i * 1000 AS event_id, {value} AS value) FROM '{FOLDER}/events.parquet', range(3) r(i)) TO '{out}/events.parquet' (FORMAT parquet)")
    return out


def against_sql(name, spark, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    df = QUERIES[name](spark, folder)
    r = c.execute(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in r.description], r.fetchall())
    return df


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["roll_median_quantile", "roll_sum_mean_sliding", "roll_std", "roll_min_max"])
def test_sliding_windows_see_peers_and_slide_over_no_frame(name, spark, tied):
    assert "RangeFrame, -" not in plan(against_sql(name, spark, tied))


def test_quantiles_of_windows(spark):
    """Many keys and buckets in a partition, nulls, infinities and NaN, against sorted lists."""
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") % 500).alias("ts"), F.expr("CASE WHEN id % 5 = 0 THEN NULL WHEN id % 97 = 1 THEN double('Infinity') ELSE double(id * 37 % 101) END").alias("v"))
    for ties in ("position", "peers"):
        f = as_timeframe(Frame(df).ordered("ts", "id"), "ts", ties=ties)
        got = {r["id"]: r["q"] for r in f.window("7s", by="k", update={"q": win.rolling_quantile("v", 0.3)}).df.collect()}
        every = df.withColumn("s", F.unix_seconds("ts")).collect()
        for x in every[::41]:
            seen = sorted(y["v"] for y in every if y["k"] == x["k"] and x["s"] - 7 < y["s"] <= x["s"] and (ties == "peers" or (y["s"], y["id"]) <= (x["s"], x["id"])) and y["v"] is not None)
            if not seen:
                assert got[x["id"]] is None
                continue
            at = (len(seen) - 1) * 0.3
            a, b = seen[int(at)], seen[min(int(at) + (at > int(at)), len(seen) - 1)]
            assert got[x["id"]] == pytest.approx(a if a == b else a + (at - int(at)) * (b - a))


def test_waiting_suppliers_in_one_row_an_order(spark, tmp_path):
    """No window over an order's suppliers; a line without a supplier is no other supplier."""
    for f in os.listdir(FOLDER):
        if f != "lineitem.parquet":
            os.symlink(f"{FOLDER}/{f}", tmp_path / f)
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN l_linenumber > 1 AND l_orderkey % 2 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey) FROM '{FOLDER}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    assert "Window" not in plan(against_sql("q21_waiting_suppliers", spark, str(tmp_path)))


@pytest.mark.parametrize("name", ["rank_multi_key", "rank_methods", "rank_pct_na_option"])
def test_ranks_cut_into_stretches(name, spark, tied, monkeypatch):
    """Each task ranks a stretch of a group's rows."""
    from tidewater.functions import ranks

    monkeypatch.setattr(ranks, "CUT_ROWS", 100)
    monkeypatch.setattr(ranks, "TASK_ROWS", 300)
    assert "__cut0" in plan(against_sql(name, spark, tied))


@pytest.mark.parametrize("name", ["boosted_trees", "boosted_trees_fit"])
def test_trees_learn_in_tasks_of_few_rows(name, spark, monkeypatch):
    import tidewater.session as session
    from tidewater.operators import models

    seen = []
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    monkeypatch.setattr(models, "spread", lambda df: seen.append(session.spread(df)) or seen[-1])
    assert QUERIES[name](spark, FOLDER).collect()
    assert seen[0].rdd.getNumPartitions() == 200 // 50
