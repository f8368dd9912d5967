"""Scalar functions with IEEE division, null-propagating extremes and checked casts, all built of Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def div(a, b) -> Column:
    """a / b as double; by zero it is infinite or NaN instead of an error."""
    a, b = col(a).cast("double"), col(b).cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).when(a < 0, -INF)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def mod(a, b) -> Column:
    """The remainder with the sign of a; by zero it is 0."""
    a, b = col(a), col(b)
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(F.try_mod(a, b), F.lit(0)))


def _same(x: Column, f) -> Column:
    big = F.isnan(x) | (F.abs(x) >= 2.0**53)
    return F.when(big, x).otherwise(f(x).cast("double"))


def ceil(x) -> Column:
    return _same(col(x).cast("double"), F.ceil)


def floor(x) -> Column:
    return _same(col(x).cast("double"), F.floor)


def trunc(x) -> Column:
    x = col(x).cast("double")
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def _log(x, f) -> Column:
    x = col(x).cast("double")
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(f(x))


def log(x) -> Column:
    return _log(x, F.ln)


def log2(x) -> Column:
    return _log(x, F.log2)


def log10(x) -> Column:
    return _log(x, F.log10)


def round_(x, mode: str = "nearest") -> Column:
    """A whole number (long) by mode nearest (half away from zero), bankers, floor, ceil or trunc."""
    x = col(x).cast("double")
    by = {"nearest": lambda: F.round(x, 0), "bankers": lambda: F.bround(x, 0), "floor": lambda: F.floor(x), "ceil": lambda: F.ceil(x), "trunc": lambda: trunc(x)}
    if mode not in by:
        raise ValueError(f"no rounding mode {mode!r}")
    return by[mode]().cast("long")


def _any_null(xs: list[Column]) -> Column:
    out = xs[0].isNull()
    for x in xs[1:]:
        out = out | x.isNull()
    return out


def pmin(*xs) -> Column:
    """The least of two or more; null if any is null."""
    xs = [col(x) for x in xs]
    return F.when(~_any_null(xs), F.least(*xs))


def pmax(*xs) -> Column:
    """The greatest of two or more; null if any is null."""
    xs = [col(x) for x in xs]
    return F.when(~_any_null(xs), F.greatest(*xs))


def to_int(x) -> Column:
    """A long; a fraction is an error, a Boolean gives 0 or 1."""
    x = col(x)
    d = x.cast("double")
    wrong = F.isnan(d) | (d != F.round(d, 0))
    return F.when(wrong, F.raise_error(F.lit("cannot make a whole number of a fraction")).cast("long")).otherwise(x.cast("long"))


def to_float(x) -> Column:
    return col(x).cast("double")


def to_int32(x) -> Column:
    """A 32-bit whole number; a fraction or a number out of range is an error."""
    y = to_int(x)
    out = (y < -(2**31)) | (y >= 2**31)
    return F.when(out, F.raise_error(F.lit("the number does not fit 32 bits")).cast("int")).otherwise(y.cast("int"))


def to_float32(x) -> Column:
    return col(x).cast("float")


def to_date(x) -> Column:
    """The UTC day of a timestamp."""
    return col(x).cast("date")


def is_nan(x) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.isnan(x))


def null_if_nan(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def null_if_not_finite(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != INF), x)


def fill_null(x, value) -> Column:
    return F.coalesce(col(x), F.lit(value))


def like(x, pattern: str) -> Column:
    """SQL LIKE where a backslash makes any next character stand for itself."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"%": ".*", "_": "."}.get(c) or re.escape(c)
        k += 1
    return col(x).rlike(f"(?s)^{out}\\z")


def substring(x, start: int, length: int | None = None) -> Column:
    """From place start, counted from 0 or back from the end, clamped to the text."""
    x = col(x)
    n = F.char_length(x)
    begin = F.least(F.lit(start), n) if start >= 0 else F.greatest(n + start, F.lit(0))
    size = n if length is None else F.lit(max(0, length))
    return F.substring(x, begin + 1, size)


def interp(*parts) -> Column:
    """Text and values joined; null if a value is null. Strings are text; pass columns for values."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else col(p).cast("string") for p in parts))


def case(*branches, default=None) -> Column:
    """(condition, value) pairs tried in order, then the default."""
    out = None
    for when, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def ieee_eq(a, b) -> Column:
    """Equality in which NaN differs from everything."""
    a, b = col(a), col(b)
    return (a == b) & ~F.isnan(a)


def date_diff_days(a, b) -> Column:
    """a - b of dates, in days, as a long."""
    return F.datediff(col(a), col(b)).cast("long")


def with_timezone(ts, zone: str) -> Column:
    """The instant of a wall-clock time in a zone; null in a gap, the earlier one in an overlap."""
    t = col(ts).cast("timestamp_ntz")
    instant = F.to_utc_timestamp(t.cast("timestamp"), zone)
    earlier = instant - F.expr("INTERVAL 1 HOUR")
    fits = F.from_utc_timestamp(instant, zone) == t.cast("timestamp")
    before = F.from_utc_timestamp(earlier, zone) == t.cast("timestamp")
    return F.when(before, earlier).when(fits, instant)


# random columns: distribution, not sequence, is what is promised


_SEEDS: list = []


def seed_rng(seed: int | None) -> None:
    """From now on random columns without a seed of their own take seeds that follow from this one; None ends that."""
    import itertools

    _SEEDS[:] = [] if seed is None else [itertools.count(seed * 1000003)]


def _seed(seed: int | None) -> int | None:
    return next(_SEEDS[0]) if seed is None and _SEEDS else seed


def rand_uniform(low=0.0, high=1.0, seed: int | None = None) -> Column:
    return F.lit(low) + F.rand(_seed(seed)) * (F.lit(high) - F.lit(low))


def rand_normal(mean=0.0, sd=1.0, seed: int | None = None) -> Column:
    return F.lit(mean) + F.randn(_seed(seed)) * F.lit(sd)


def rand_exponential(rate=1.0, seed: int | None = None) -> Column:
    return -F.ln(1 - F.rand(_seed(seed))) / F.lit(rate)


def rand_bernoulli(p=0.5, seed: int | None = None) -> Column:
    return (F.rand(_seed(seed)) < F.lit(p)).cast("long")


def rand_int(low: int, high: int, seed: int | None = None) -> Column:
    """Whole numbers from low to high, both included."""
    return (F.lit(low) + F.floor(F.rand(_seed(seed)) * (high - low + 1))).cast("long")


def _drawn(draw) -> Column:
    import numpy as np
    import pandas as pd

    def f(seeds):
        rng = np.random.default_rng(abs(int(np.float64(seeds.iloc[0]).view(np.int64))) if len(seeds) else 0)
        return pd.Series(draw(rng, len(seeds)))

    f.__annotations__ = {"seeds": pd.Series, "return": pd.Series}
    return F.pandas_udf(f, "double")


def rand_gamma(shape=1.0, scale=1.0, seed: int | None = None) -> Column:
    return _drawn(lambda rng, n: rng.gamma(shape, scale, n))(F.rand(_seed(seed)))


def rand_student_t(df=1.0, seed: int | None = None) -> Column:
    return _drawn(lambda rng, n: rng.standard_t(df, n))(F.rand(_seed(seed)))


def rand_poisson(lam=1.0, seed: int | None = None) -> Column:
    return _drawn(lambda rng, n: rng.poisson(lam, n).astype("float64"))(F.rand(_seed(seed))).cast("long")
