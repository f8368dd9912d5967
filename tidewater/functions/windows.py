"""Functions of neighbouring rows: rolling windows, lags, running values, fills and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .aggregates import fold_ewma, kurtosis_of, skew_of
from .deferred import Context, Deferred, Part, resolve
from .ranks import Rank


def _spec(c: Context, frame) -> WindowSpec:
    """Aligned [floor(t / D) D, t], or the last n rows."""
    if isinstance(frame, int):
        return c.ordered().rowsBetween(-(frame - 1), W.currentRow)
    order = list(dict.fromkeys([c.time, *c.order]))
    return W.partitionBy(*(F.col(k) for k in c.by), F.floor(c.ticks() / c.width(frame))).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def rolled(kind: str, x=None, *args, window=None) -> Deferred:
    """A rolling function; its own window (rows or duration) goes before that of the clause."""

    def build(c: Context) -> Column:
        frame = window if window is not None else c.window
        if frame is None:
            raise ValueError("a rolling function needs a window clause or a window of its own")
        if isinstance(frame, str):
            c.guard()
            c.ticks()
            if not c.aligned:
                width = c.width(frame)
                v = F.lit(1) if x is None else F.lit(None) if c.ready is not None else resolve(x, c)
                return c.part(Part(kind, v, args, width))
        w = _spec(c, frame)
        v = resolve(x, c) if x is not None else F.lit(1)
        n = F.count(v).over(w)
        simple = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
        if kind in simple:
            return simple[kind](v).over(w)
        if kind in ("median", "quantile"):
            return F.percentile(v, args[0] if args else 0.5).over(w)
        if kind == "std":
            return F.when(n == 1, 0.0).otherwise(F.stddev_samp(v).over(w))
        if kind == "skew":
            return F.when((n > 0) & (n < 3), 0.0).otherwise(skew_of(F.skewness(v).over(w), n))
        if kind == "kurtosis":
            return F.when((n > 0) & (n < 4), 0.0).otherwise(kurtosis_of(F.kurtosis(v).over(w), n))
        if kind in ("first", "last"):
            return (F.first if kind == "first" else F.last)(v).over(w)
        if kind == "ewma":
            d = v.cast("double")
            return fold_ewma(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*(c.order or [c.time])).alias("o"), d.alias("v"))).over(w)), lambda e: e["v"]), lambda y: y.isNotNull()), args[0])
        raise ValueError(f"no rolling function {kind!r}")

    return Deferred(build)


def rolling_sum(x, window=None) -> Deferred:
    return rolled("sum", x, window=window)


def rolling_mean(x, window=None) -> Deferred:
    return rolled("mean", x, window=window)


def rolling_min(x, window=None) -> Deferred:
    return rolled("min", x, window=window)


def rolling_max(x, window=None) -> Deferred:
    return rolled("max", x, window=window)


def rolling_count(window=None) -> Deferred:
    return rolled("count", window=window)


def rolling_median(x, window=None) -> Deferred:
    return rolled("median", x, window=window)


def rolling_quantile(x, p: float, window=None) -> Deferred:
    return rolled("quantile", x, p, window=window)


def rolling_std(x, window=None) -> Deferred:
    """0 where the window has one value."""
    return rolled("std", x, window=window)


def rolling_skew(x, window=None) -> Deferred:
    """0 where the window has fewer than three values."""
    return rolled("skew", x, window=window)


def rolling_kurtosis(x, window=None) -> Deferred:
    """0 where the window has fewer than four values."""
    return rolled("kurtosis", x, window=window)


def rolling_ewma(x, alpha: float, window=None) -> Deferred:
    return rolled("ewma", x, alpha, window=window)


def rolling_first(x, window=None) -> Deferred:
    """The value of the window's first row, null or not."""
    return rolled("first", x, window=window)


def rolling_last(x, window=None) -> Deferred:
    return rolled("last", x, window=window)


def _bound(start: bool) -> Deferred:
    def build(c: Context) -> Column:
        if not isinstance(c.window, str):
            raise ValueError("window bounds need a time window")
        t, d = c.ticks(), c.width(c.window)
        begin = F.floor(t / d) * d if c.aligned else t - d
        at = begin if start else (begin + d if c.aligned else t)
        return {"timestamp": lambda: F.timestamp_micros(at.cast("long")), "date": lambda: F.date_from_unix_date(at.cast("int")), "long": lambda: at.cast("long")}[c.time_kind]()

    return Deferred(build)


def window_start() -> Deferred:
    return _bound(True)


def window_end() -> Deferred:
    return _bound(False)


def lag(x, n: int = 1) -> Deferred:
    return Deferred(lambda c: F.lag(resolve(x, c), n).over(c.ordered()))


def lead(x, n: int = 1) -> Deferred:
    return Deferred(lambda c: F.lead(resolve(x, c), n).over(c.ordered()))


def cumsum(x) -> Deferred:
    """The running sum; a null adds nothing."""
    return Deferred(lambda c: F.sum(resolve(x, c)).over(c.ordered().rowsBetween(W.unboundedPreceding, W.currentRow)))


def cumprod(x) -> Deferred:
    return Deferred(lambda c: F.product(resolve(x, c)).over(c.ordered().rowsBetween(W.unboundedPreceding, W.currentRow)))


def fill_forward(x) -> Deferred:
    return Deferred(lambda c: F.last(resolve(x, c), True).over(c.ordered().rowsBetween(W.unboundedPreceding, W.currentRow)))


def fill_backward(x) -> Deferred:
    return Deferred(lambda c: F.first(resolve(x, c), True).over(c.ordered().rowsBetween(W.currentRow, W.unboundedFollowing)))


def rank(keys, method: str = "average", ascending: bool = True, na_option: str = "keep", pct: bool = False) -> Deferred:
    """Ranks in each group. keys: a column or name, or a list of (name, ascending) pairs."""
    if method not in ("average", "min", "max", "first", "dense") or na_option not in ("keep", "top", "bottom"):
        raise ValueError("no such rank method or na_option")
    pairs = keys if isinstance(keys, list) else [(keys, ascending)]

    def build(c: Context) -> Column:
        cols = [(resolve(k, c), up) for k, up in pairs]
        null = cols[0][0].isNull()
        for k, _ in cols[1:]:
            null = null | k.isNull()
        groups = [F.col(k) for k in c.by] + ([null] if na_option == "keep" else [])
        order = [((k.asc_nulls_first() if up else k.desc_nulls_first()) if na_option == "top" else (k.asc_nulls_last() if up else k.desc_nulls_last())) for k, up in cols]
        if method == "first" and not c.order:
            raise ValueError("rank by first reads row order: state it with order=[...] on the frame")

        def finish(stretch: Column | None = None, ahead: Column | None = None, levels: Column | None = None, all_: Column | None = None) -> Column:
            within = groups if stretch is None else [*groups, stretch]
            w = W.partitionBy(*within).orderBy(*order)
            before = lambda r, x: r if x is None else r + F.coalesce(x, F.lit(0))
            low, peers = before(F.rank().over(w), ahead), F.count(F.lit(1)).over(W.partitionBy(*within, *(k for k, _ in cols)))
            value = {
                "min": lambda: low, "max": lambda: low + peers - 1, "average": lambda: low + (peers - 1) / 2, "dense": lambda: before(F.dense_rank().over(w), levels),
                "first": lambda: before(F.row_number().over(W.partitionBy(*within).orderBy(*order, *c.order)), ahead),
            }[method]()
            if pct:
                n = F.count(F.lit(1)).over(W.partitionBy(*within))
                value = value / (n if all_ is None else F.coalesce(all_, n))
            value = value.cast("double" if pct or method == "average" else "long")
            return F.when(~null, value) if na_option == "keep" else value

        ties = [(F.col(k), True, False) for k in c.order] if method == "first" else []
        return c.part(Rank(groups, [*((k, up, na_option != "top") for k, up in cols), *ties], finish)) if c.seen is not None or c.ready is not None else finish()

    return Deferred(build)
