"""Sliding time windows (t - D, t] in work that follows the rows, however many rows a window holds.

On a grid of step D the window of a row is the end of the bucket before (times later than t - D) and the
beginning of its own (up to t). Each row goes to its own bucket and to the next one, where both lie on one
scale, the offset from the bucket's start. The beginning is a running value by rising offset over a
bucket's own rows, the end a running value by falling offset over the rows of the bucket before, and the
two are put together; no step is undone, so sums lose nothing. Quantiles have no such parts: they are
looked up in a wavelet matrix, a few numpy steps a bit for all windows of many buckets at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .aggregates import fold_ewma, kurtosis_of, skew_of
from .deferred import Context, Part

#: Rows whose quantiles are looked up at once, at least; more if one bucket with the one before has more.
CHUNK = 200_000


def slide(df: DataFrame, parts: list[Part], c: Context) -> tuple[DataFrame, list[str]]:
    """df with a column for each part, and their names; each width has its own grid."""
    names = [f"__part{i}" for i in range(len(parts))]
    for width in dict.fromkeys(p.width for p in parts):
        df = _grid(df, {n: p for n, p in zip(names, parts, strict=True) if p.width == width}, width, c)
    return df, names


def _grid(df: DataFrame, parts: dict[str, Part], width: int, c: Context) -> DataFrame:
    types = {n: _type(df, p) for n, p in parts.items()}
    df = df.withColumns({f"__v_{n}": p.value.cast("double") if p.kind in ("median", "quantile") else p.value for n, p in parts.items()})
    df = df.withColumn("__tick", c.ticks().cast("long")).withColumn("__at", F.pmod("__tick", F.lit(width)))
    df = df.withColumn("__bucket", F.call_function("div", F.col("__tick") - F.col("__at"), F.lit(width)))
    df = df.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("__bucket", F.col("__bucket") + F.when(F.col("__own"), 0).otherwise(1))
    df = spread(df, *c.by, "__bucket")
    drawn = {n: p for n, p in parts.items() if p.kind in ("median", "quantile")}
    df = df.withColumns({n: _joined(p, F.col(f"__v_{n}"), types[n], c) for n, p in parts.items() if n not in drawn})
    if drawn:
        df = _quantiles(df, {n: p.args[0] if p.args else 0.5 for n, p in drawn.items()}, c)
    return df.where("__own").drop("__tick", "__at", "__bucket", "__own", *(f"__v_{n}" for n in parts))


def _type(df: DataFrame, p: Part) -> T.DataType | None:
    plain = {"sum": F.sum, "mean": F.avg}
    return df.select(plain[p.kind](p.value)).schema[0].dataType if p.kind in plain else None


def _joined(p: Part, v: Column, kind: T.DataType | None, c: Context) -> Column:
    """The part's value from the beginning of the row's own bucket and the end of the one before."""
    own, bucket = F.col("__own"), [*c.by, "__bucket"]
    order = c.order or [c.time]
    peers = c.ties == "peers"
    rising = W.partitionBy(*bucket).orderBy("__at", *([] if peers else order))
    rising = (rising.rangeBetween if peers else rising.rowsBetween)(W.unboundedPreceding, W.currentRow)
    # rows of the bucket before at the same offset are D old: they come after the row, outside
    falling = W.partitionBy(*bucket).orderBy(F.desc("__at"), F.desc("__own"), *(F.desc(k) for k in order)).rowsBetween(W.unboundedPreceding, W.currentRow)

    def both(f, x: Column = v) -> tuple[Column, Column]:
        return f(F.when(~own, x)).over(falling), f(F.when(own, x)).over(rising)

    def total(x: Column = v) -> Column:
        a, b = both(F.sum, x)
        return F.coalesce(a + b, a, b)

    def moments() -> tuple[Column, tuple[Column, ...]]:
        """Count and central sums of powers 2, 3 and 4; all values equal give 0 exactly."""
        d = v.cast("double")
        n, sums = _powers(*both(F.count, d), *both(F.avg, d), both(F.var_pop, d), both(F.skewness, d), both(F.kurtosis, d), p.kind)
        low, high = F.least(*both(F.min, d)), F.greatest(*both(F.max, d))
        return n, tuple(F.when((low == high) & (F.abs(low) < float("inf")), 0.0).otherwise(m) for m in sums)

    if p.kind == "count":
        a, b = both(F.count)
        return a + b
    if p.kind == "sum":
        return total().cast(kind)
    if p.kind == "mean":
        x = v.cast("double") if isinstance(kind, T.DoubleType) else v
        a, b = both(F.count)
        return (total(x) / F.nullif(a + b, F.lit(0))).cast(kind)
    if p.kind in ("min", "max"):
        return (F.least if p.kind == "min" else F.greatest)(*both(F.min if p.kind == "min" else F.max))
    if p.kind == "std":
        n, (m2, *_) = moments()
        return F.when(n == 1, 0.0).when(n > 1, F.sqrt(m2 / (n - 1)))
    if p.kind == "skew":
        n, (m2, m3, _) = moments()
        g = F.when(m2 == 0, F.lit(None)).otherwise(F.sqrt(n) * m3 / F.sqrt(m2 * m2 * m2))
        return F.when((n > 0) & (n < 3), 0.0).otherwise(skew_of(g, n))
    if p.kind == "kurtosis":
        n, (m2, _, m4) = moments()
        g = F.when(m2 == 0, F.lit(None)).otherwise(n * m4 / (m2 * m2) - 3)
        return F.when((n > 0) & (n < 4), 0.0).otherwise(kurtosis_of(g, n))
    here, box = F.struct(*dict.fromkeys([c.time, *order])), F.struct(v.alias("v"))
    if p.kind == "first":
        oldest = F.last(F.when(~own, box), True).over(falling)
        return F.coalesce(oldest, F.min_by(box, F.when(own, here)).over(rising))["v"]
    if p.kind == "last":
        return F.max_by(box, F.when(own, here)).over(rising)["v"] if peers else v
    if p.kind == "ewma":
        # the lists of a window grow with it: only here
        rows = F.concat(*both(F.collect_list, F.struct(F.struct(*order).alias("o"), v.cast("double").alias("v"))))
        return fold_ewma(F.filter(F.transform(F.array_sort(rows), lambda e: e["v"]), lambda y: y.isNotNull()), p.args[0])
    raise ValueError(f"no rolling function {p.kind!r}")


def _powers(na, nb, ma, mb, var, skew, kurt, kind: str) -> tuple[Column, tuple[Column, ...]]:
    """Central sums of two sets of values put together, from counts, means, population variances, skewness and kurtosis."""
    na, nb = na.cast("double"), nb.cast("double")
    n, d = na + nb, F.coalesce(mb - ma, F.lit(0.0))
    a2, b2 = (F.coalesce(x * k, F.lit(0.0)) for x, k in zip(var, (na, nb), strict=True))
    full = F.nullif(n, F.lit(0.0))
    m2 = a2 + b2 + d * d * na * nb / full
    if kind == "std":
        return n, (m2,)
    a3, b3 = (F.when(m == 0, 0.0).otherwise(F.coalesce(g * F.sqrt(m * m * m) / F.sqrt(k), F.lit(0.0))) for g, m, k in zip(skew, (a2, b2), (na, nb), strict=True))
    a4, b4 = (F.when(m == 0, 0.0).otherwise(F.coalesce((g + 3) * m * m / k, F.lit(0.0))) for g, m, k in zip(kurt, (a2, b2), (na, nb), strict=True))
    r = d / full
    m3 = a3 + b3 + d * r * r * na * nb * (na - nb) + 3 * r * (na * b2 - nb * a2)
    m4 = a4 + b4 + d * r * r * r * na * nb * (na * na - na * nb + nb * nb) + 6 * r * r * (na * na * b2 + nb * nb * a2) + 4 * r * (na * b3 - nb * a3)
    return n, (m2, m3, m4)


# ---- quantiles


def _quantiles(df: DataFrame, shares: dict[str, float], c: Context) -> DataFrame:
    """The rows that are in their own bucket, with exact quantiles as columns.

    The window's sort brings a bucket's rows together, those of the bucket before first; __row tells where one begins.
    """
    w = W.partitionBy(*c.by, "__bucket").orderBy("__own", "__at", *(c.order or [c.time]))
    df = df.withColumn("__row", F.row_number().over(w))
    schema = T.StructType([*(f for f in df.schema if f.name != "__row"), *(T.StructField(n, T.DoubleType()) for n in shares)])
    peers = c.ties == "peers"

    def answer(table: pa.Table) -> pa.Table:
        get = lambda n: table[n].to_numpy()
        own = get("__own").astype(bool)
        lo, hi = _ranges(own, get("__row"), get("__at"), peers)
        out = table.filter(pa.array(own)).drop_columns(["__row"])
        for n, p in shares.items():
            value = table[f"__v_{n}"].combine_chunks()
            out = out.append_column(n, _pick(value.fill_null(0.0).to_numpy(), ~value.is_null().to_numpy(zero_copy_only=False), lo, hi, p))
        return out.combine_chunks()

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch["__row"].to_numpy()
            if ((row != 1) & (row != np.concatenate([[last], row[:-1]]) + 1)).any():
                raise RuntimeError("rows of a bucket came apart")
            last = int(row[-1])
            starts = np.flatnonzero(row == 1)
            if size + batch.num_rows > CHUNK and len(starts) and (held or starts[-1]):
                cut = int(starts[-1])
                yield from answer(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches(20_000)
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from answer(pa.Table.from_batches(held)).to_batches(20_000)

    return df.mapInArrow(run, schema)


def _ranges(own: np.ndarray, row: np.ndarray, at: np.ndarray, peers: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each own row the range [lo, hi) of its window; a bucket's rows stand together, those of the bucket before first."""
    start = np.flatnonzero(row == 1)
    bucket = np.cumsum(row == 1) - 1
    _, code = np.unique(at, return_inverse=True)
    key = bucket * (int(code.max()) + 1) + code
    me = np.flatnonzero(own)
    before = np.cumsum(~own) - (~own)  # rows of buckets before, ahead of each row
    lo = start[bucket[me]] + np.searchsorted(key[~own], key[me], "right") - before[start[bucket[me]]]
    hi = me + 1
    if peers and len(me):
        new = np.concatenate([[True], key[me][1:] != key[me][:-1]])
        end = np.concatenate([np.flatnonzero(new)[1:], [len(me)]])
        hi = me[end[np.cumsum(new) - 1] - 1] + 1
    return lo, hi


def _pick(values: np.ndarray, some: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: float) -> pa.Array:
    """The quantile of values[lo:hi] where some, for each range: interpolated, null without values, NaN last."""
    seen = np.concatenate([[0], np.cumsum(some)])
    lo, hi = seen[lo], seen[hi]
    levels, codes = np.unique(values[some], return_inverse=True)
    n = hi - lo
    whole = n > 0
    place = np.where(whole, (n - 1) * p, 0.0)
    low, high = np.floor(place), np.ceil(place)
    if not len(levels):
        return pa.nulls(len(lo), pa.float64())
    a = levels[_smallest(codes, lo, hi, low.astype(np.int64), len(levels))]
    b = levels[_smallest(codes, lo, hi, high.astype(np.int64), len(levels))]
    with np.errstate(invalid="ignore"):
        mixed = np.where((low == high) | (a == b), a, (high - place) * a + (place - low) * b)
    return pa.array(mixed, pa.float64(), mask=~whole)


def _smallest(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray, levels: int) -> np.ndarray:
    """The k-th smallest (from 0) of codes[lo:hi] for each range, by a wavelet matrix; codes are below levels."""
    lo, hi, found = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
    for bit in reversed(range((levels - 1).bit_length())):
        one = (codes >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        zl, zh = zeros[lo], zeros[hi]
        up = k >= zh - zl
        k = np.where(up, k - (zh - zl), k)
        found += up.astype(np.int64) << bit
        lo, hi = np.where(up, zeros[-1] + lo - zl, zl), np.where(up, zeros[-1] + hi - zh, zh)
        codes = np.concatenate([codes[~one], codes[one]])
    return np.minimum(found, levels - 1)
