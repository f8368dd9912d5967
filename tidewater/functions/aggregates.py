"""Aggregates. In a select they make a row a group, in an update they fill the group, in a window they roll."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .deferred import Context, Deferred, resolve


def _agg(kind: str, x, make: Callable[[Context, Column], Column], *args) -> Deferred:
    if isinstance(x, Deferred) and x.aggregate:
        raise ValueError("an aggregate inside an aggregate")

    def build(c: Context) -> Column:
        if c.mode == "window":
            from . import windows

            return windows.rolled(kind, x, *args).build(c)
        value = resolve(x, c) if x is not None else F.lit(1)
        if c.mode == "aggregate":
            return make(c, value)
        return make(c, value).over(W.partitionBy(*c.by))

    return Deferred(build, aggregate=True)


def sum(x) -> Deferred:  # noqa: A001
    return _agg("sum", x, lambda c, v: F.sum(v))


def mean(x) -> Deferred:
    return _agg("mean", x, lambda c, v: F.avg(v))


def min(x) -> Deferred:  # noqa: A001
    return _agg("min", x, lambda c, v: F.min(v))


def max(x) -> Deferred:  # noqa: A001
    return _agg("max", x, lambda c, v: F.max(v))


def count(x=None) -> Deferred:
    """Rows, or the non-null values of x."""
    return _agg("count", x, lambda c, v: F.count(v))


def _by_order(c: Context, v: Column) -> Column:
    if not c.order:
        raise ValueError("first, last and ewma read row order: state it with order=[...] on the frame")
    return F.when(v.isNotNull(), F.struct(*c.order))


def first(x) -> Deferred:
    """The first non-null value in the frame's order."""
    return _agg("first", x, lambda c, v: F.min_by(v, _by_order(c, v)))


def last(x) -> Deferred:
    return _agg("last", x, lambda c, v: F.max_by(v, _by_order(c, v)))


def median(x) -> Deferred:
    return _agg("median", x, lambda c, v: F.percentile(v, 0.5))


def quantile(x, p: float) -> Deferred:
    """Exact, interpolated between neighbours."""
    return _agg("quantile", x, lambda c, v: F.percentile(v, p), p)


def std(x) -> Deferred:
    """Sample standard deviation; null for fewer than two values."""
    return _agg("std", x, lambda c, v: F.stddev_samp(v))


def skew_of(g1: Column, n: Column) -> Column:
    """Adjusted Fisher-Pearson skewness from the population one; 0 if all values are equal."""
    n = n.cast("double")
    return F.when(n >= 3, F.coalesce(F.when(F.isnan(g1), 0.0).otherwise(g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))), F.lit(0.0)))


def kurtosis_of(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis from the population one; 0 if all values are equal."""
    n = n.cast("double")
    full = ((n + 1) * g2 + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, F.coalesce(F.when(F.isnan(g2), 0.0).otherwise(full), F.lit(0.0)))


def _shape(kind: str, x, f, finish) -> Deferred:
    def build(c: Context) -> Column:
        if c.mode == "window":
            from . import windows

            return windows.rolled(kind, x).build(c)
        v = resolve(x, c).cast("double")
        over = (lambda a: a) if c.mode == "aggregate" else lambda a: a.over(W.partitionBy(*c.by))
        return finish(over(f(v)), over(F.count(v)))

    return Deferred(build, aggregate=True)


def skew(x) -> Deferred:
    return _shape("skew", x, F.skewness, skew_of)


def kurtosis(x) -> Deferred:
    return _shape("kurtosis", x, F.kurtosis, kurtosis_of)


def fold_ewma(values: Column, alpha: float) -> Column:
    """s = alpha x + (1 - alpha) s over an ordered array of non-null doubles, seeded by its first."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(alpha * x + (1 - alpha) * s))


def ewma(x, alpha: float) -> Deferred:
    def build(c: Context) -> Column:
        if c.mode == "window":
            from . import windows

            return windows.rolled("ewma", x, alpha).build(c)
        v = resolve(x, c).cast("double")
        rows = F.collect_list(F.when(v.isNotNull(), F.struct(*c.order, v.alias("__v"))))
        if not c.order:
            _by_order(c, v)
        if c.mode != "aggregate":
            rows = rows.over(W.partitionBy(*c.by))
        return fold_ewma(F.transform(F.array_sort(rows), lambda e: e["__v"]), alpha)

    return Deferred(build, aggregate=True)
