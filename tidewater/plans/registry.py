"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame, as_timeframe
from ..functions.deferred import Deferred

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Frames of the tables of one folder; events come ordered and with their time index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def df(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> Frame:
        if name.startswith("_"):
            raise AttributeError(name)
        frame = Frame(self.df(name))
        return as_timeframe(frame.ordered("ts", "event_id"), "ts") if name == "events" else frame


def query(sql: str | None = None):
    """Registers a function of Tables that returns a Frame or a DataFrame, under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.df if isinstance(out, Frame) else out

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(e) -> Column:
    """Rounded to six places, on both sides of a comparison."""
    return e.map(lambda x: F.round(x.cast("double"), 6)) if isinstance(e, Deferred) else F.round(e.cast("double"), 6)
