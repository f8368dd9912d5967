"""Frame: a Spark DataFrame with the order, time index and grouping claims that clauses read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import durations, ranks, sliding
from .functions.deferred import Context, Deferred, Part, is_aggregate, resolve
from .functions.ranks import Rank
from .operators import joins, models, reshape

ALONE = {
    "distinct": {"select", "update"}, "select": {"update"}, "head": {"tail"}, "melt": {"dcast"},
    "cov": {"corr", "transpose"}, "corr": {"transpose"},
}
RESHAPES = {"distinct", "update", "order", "window", "resample"}
MATRIX = {"select", "update", "by", "distinct", "melt", "dcast", "window", "resample"}


def _sort(k) -> Column:
    """A sort key: a name, (name, "desc"), or a column; nulls last either way."""
    if isinstance(k, Column):
        return k
    name, way = k if isinstance(k, tuple) else (k, "asc")
    return F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_last()


@dataclass(frozen=True)
class Frame:
    """Clauses are methods, or all at once in block(). df: the rows. order: columns that fix row order."""

    df: DataFrame
    order_by: tuple[str, ...] = ()
    time_index: str | None = None
    grouped_by: tuple[str, ...] = ()
    ties: str = "position"
    zone: str | None = None

    # ---- building blocks

    def _as(self, df: DataFrame, **changes) -> Frame:
        out = replace(self, df=df, **changes)
        kept = set(df.columns)
        return replace(out, order_by=tuple(c for c in out.order_by if c in kept), time_index=out.time_index if out.time_index in kept else None)

    def _time_kind(self) -> str:
        if self.time_index is None:
            return "timestamp"
        kind = self.df.schema[self.time_index].dataType
        return "date" if isinstance(kind, T.DateType) else "long" if isinstance(kind, T.LongType) else "timestamp"

    def _context(self, mode: str, by=(), window=None, aligned=False) -> Context:
        order = list(self.order_by) or ([self.time_index] if self.time_index else [])
        return Context(mode, list(by), order, self.time_index, self._time_kind(), window, aligned, self.ties, self.grouped_by)

    def _keys(self, by) -> tuple[DataFrame, list[str]]:
        """Plain key names; keys given as {name: expression} become columns first."""
        if by is None:
            return self.df, []
        if isinstance(by, dict):
            df, made, parts = self._made(self.df, by, self._context("row"))
            return df.withColumns(made).drop(*parts), list(by)
        return self.df, [by] if isinstance(by, str) else list(by)

    def ordered(self, *columns: str) -> Frame:
        """States which columns fix the rows' order; lags, fills, first and the like read it."""
        return replace(self, order_by=tuple(columns), grouped_by=())

    # ---- clauses

    def filter(self, e) -> Frame:
        if isinstance(e, Deferred):
            if e.aggregate:
                raise ValueError("no aggregates in a filter")
            df, made, parts = self._made(self.df, {"__keep": e}, self._context("row"))
            return self._as(df.withColumns(made).where("__keep").drop("__keep", *parts))
        return self._as(self.df.where(e))

    def rename(self, **new_of_old: str) -> Frame:
        to = {old: new for new, old in new_of_old.items()}
        change = lambda c: to.get(c, c)
        return replace(self, df=self.df.withColumnsRenamed(to), order_by=tuple(map(change, self.order_by)), time_index=change(self.time_index) if self.time_index else None)

    def select(self, *names, by=None, **fields) -> Frame:
        """Columns and computed fields; with aggregates a row for each group of `by`."""
        items = {**{n: F.col(n) for n in names}, **fields}
        if any(is_aggregate(e) for e in items.values()) or by is not None:
            df, keys = self._keys(by)
            plain = [n for n, e in items.items() if not is_aggregate(e) and n not in keys]
            if plain:
                raise ValueError(f"{plain}: neither a key nor an aggregate")
            c = replace(self._context("aggregate"), by=keys)
            aggs = [e.build(c).alias(n) for n, e in items.items() if is_aggregate(e)]
            out = (df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)) if aggs else df.select(*keys).distinct()
            wanted = keys + [n for n, e in items.items() if is_aggregate(e)]
            return self._as(out.select(*wanted), order_by=(), time_index=None, grouped_by=())
        df, made, _ = self._made(self.df, items, self._context("row"))
        return self._as(df.select(*(e.alias(n) for n, e in made.items())))

    def distinct(self, *names: str) -> Frame:
        return self._as((self.df.select(*names) if names else self.df).distinct(), order_by=())

    def update(self, *, by=None, where=None, **fields) -> Frame:
        """Adds or replaces columns, all seen as they were before; with `by`, within groups; with `where`, in its rows only."""
        if where is not None and by is not None:
            raise ValueError("a where guard takes no by")
        df, keys = self._keys(by)
        names = df.columns
        c = self._context("row", keys)
        df, made, parts = self._made(df, fields, c)
        if where is not None:
            made = {n: F.when(where, e).otherwise(F.col(n) if n in names else F.lit(None)) for n, e in made.items()}
        df = df.withColumns(made).drop(*parts)
        if isinstance(by, dict):
            df = df.drop(*(k for k in keys if k not in self.df.columns))
        return self._as(df)

    def _made(self, df: DataFrame, fields: dict, c: Context) -> tuple[DataFrame, dict[str, Column], list[str]]:
        """df with all that its fields need computed beforehand, the columns of the fields, and names to drop after."""
        parts: list[Part | Rank] = []
        for e in fields.values():
            resolve(e, replace(c, seen=parts))
        if not parts:
            return df, {n: resolve(e, c) for n, e in fields.items()}, []
        slides = [p for p in parts if isinstance(p, Part)]
        df, names = sliding.slide(df, slides, c)
        df, placed, extra = ranks.cut(df, [p for p in parts if isinstance(p, Rank)])
        slid, placed = iter(map(F.col, names)), iter(placed)
        ready = [next(slid if isinstance(p, Part) else placed) for p in parts]
        return df, {n: resolve(e, replace(c, ready=ready)) for n, e in fields.items()}, [*names, *extra]

    def update_tuple(self, names: list[str], f: Callable[[DataFrame], Column]) -> Frame:
        """Assigns the fields of one struct column, by place, to names."""
        wide = self.df.withColumn("__t", f(self.df))
        parts = wide.schema["__t"].dataType.names
        if len(parts) != len(names):
            raise ValueError(f"{len(parts)} values for {len(names)} names")
        return self._as(wide.withColumns({n: F.col("__t")[p] for n, p in zip(names, parts, strict=True)}).drop("__t"))

    def update_merge(self, f: Callable[[DataFrame], Column]) -> Frame:
        """Adds all fields of one struct column under their own names."""
        wide = self.df.withColumn("__t", f(self.df))
        return self._as(wide.withColumns({p: F.col("__t")[p] for p in wide.schema["__t"].dataType.names}).drop("__t"))

    def order(self, *keys) -> Frame:
        """Sorts, nulls last; no keys: by all columns. A time frame adds its index as a tie-break."""
        keys = keys or tuple(self.df.columns)
        named = [k[0] if isinstance(k, tuple) else k for k in keys if not isinstance(k, Column)]
        extra = [self.time_index] if self.time_index and self.time_index not in named else []
        return self._as(self.df.orderBy(*map(_sort, [*keys, *extra])))

    def _edge(self, n: int, by, last: bool, order) -> Frame:
        if n < 0:
            raise ValueError("head and tail need a number of rows that is not negative")
        order = list(order or self.order_by)
        if by is None and not order and not last:
            return self._as(self.df.limit(n))
        if not order:
            raise ValueError("this head or tail reads row order: state it with ordered() or order=")
        df, keys = self._keys(by)
        sort = [_sort(k) for k in order]
        if last:
            flip = [(k[0], "asc" if k[1] == "desc" else "desc") if isinstance(k, tuple) else (k, "desc") for k in order]
            sort = [F.col(k).desc_nulls_first() if way == "desc" else F.col(k).asc_nulls_first() for k, way in flip]
        if not keys:
            return self._as(df.orderBy(*sort).limit(n))
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*sort))
        return self._as(df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n"))

    def head(self, n: int, by=None, order=None) -> Frame:
        return self._edge(n, by, False, order)

    def tail(self, n: int, by=None, order=None) -> Frame:
        return self._edge(n, by, True, order)

    def window(self, d: str, aligned: bool = False, by=None, select: dict | None = None, update: dict | None = None) -> Frame:
        """Rolling fields over (t - d, t], or aligned from floor(t / d) d. select keeps time, keys and fields only."""
        df, keys = self._keys(by)
        c = self._context("window", keys, d, aligned)
        if self.time_index is None:
            raise ValueError("window needs a time frame")
        fields = select if select is not None else update or {}
        df, made, parts = self._made(df, fields, c)
        if select is not None:
            return self._as(df.select(self.time_index, *(k for k in keys if k != self.time_index), *(e.alias(n) for n, e in made.items())), grouped_by=tuple(keys))
        return self._as(df.withColumns(made).drop(*parts), grouped_by=tuple(keys))

    def resample(self, d: str, by=None, **fields) -> Frame:
        """A row for each bucket [floor(t / d) d, + d) that has rows, and group; local days and hours if the frame has a zone."""
        if self.time_index is None or self._time_kind() == "date":
            raise ValueError("resample needs a time frame over timestamps")
        _, keys = self._keys(by)
        t, kind = self.time_index, self._time_kind()
        width = durations.ticks(d, kind)
        if kind == "long":
            bucket = F.floor(F.col(t) / width).cast("long") * width
        else:
            at = F.col(t).cast("timestamp")
            if self.zone:
                at = F.from_utc_timestamp(at, self.zone)
            micros = F.unix_micros(at)
            bucket = F.timestamp_micros((micros - F.pmod(micros, F.lit(width))).cast("long"))
            bucket = F.to_utc_timestamp(bucket, self.zone) if self.zone else bucket
            bucket = bucket.cast(self.df.schema[t].dataType)
        missing = F.raise_error(F.lit(f"the time index {t} has a null")).cast(self.df.schema[t].dataType)
        df = self.df.withColumn("__bucket", F.coalesce(bucket, missing))
        c = replace(self._context("aggregate"), by=keys)
        out = df.groupBy("__bucket", *keys).agg(*(e.build(c).alias(n) for n, e in fields.items()))
        return replace(self._as(out.withColumnRenamed("__bucket", t)), time_index=t, order_by=(), grouped_by=tuple(keys))

    # ---- shape, joins, models

    def melt(self, *ids: str, select: list[str] | None = None) -> Frame:
        return self._as(reshape.melt(self.df, list(ids), select), order_by=(), time_index=None)

    def dcast(self, pivot: str, select: str, by: list[str] | None = None, values: list | None = None) -> Frame:
        return self._as(reshape.dcast(self.df, pivot, select, by, list(self.order_by) or None, values), order_by=(), time_index=None)

    def cov(self) -> Frame:
        return Frame(reshape.cov(self.df))

    def corr(self) -> Frame:
        return Frame(reshape.corr(self.df))

    def transpose(self) -> Frame:
        return Frame(reshape.transpose(self.df, list(self.order_by) or None))

    def join(self, other: Frame, on=None, how: str = "inner", **options) -> Frame:
        if options.get("take") in ("first", "last") and "right_order" not in options:
            options["right_order"] = list(other.order_by)
        return self._as(joins.join(self.df, other.df, on, how, **options), order_by=())

    def asof(self, other: Frame, by: list[str] | None = None, **options) -> Frame:
        if self.time_index is None or other.time_index is None:
            raise ValueError("an as-of join needs two time frames")
        return self._as(joins.asof(self.df, other.df, self.time_index, by, other.time_index, right_order=list(other.order_by) or None, **options))

    def model(self, formula: str, method: str = "ols", **params) -> models.ModelResult:
        return models.fit(self.df, formula, method, list(self.order_by) or None, **params)

    def ascribe(self, schema: str | dict[str, str]) -> Frame:
        """Checks that the named columns are there with these types."""
        want = T._parse_datatype_string(schema) if isinstance(schema, str) else T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in schema.items()])
        for f in want:
            if f.name not in self.df.columns or self.df.schema[f.name].dataType != f.dataType:
                raise TypeError(f"the table has no column {f.name} of type {f.dataType.simpleString()}")
        return self

    def text(self, rows: int = 20) -> str:
        """The first rows as a text table."""
        return self.df._show_string(rows, truncate=False)

    def show(self, rows: int = 20) -> None:
        print(self.text(rows))

    def columns(self) -> Frame:
        return Frame(reshape.columns_of(self.df))

    def block(self, **clauses) -> Frame:
        """All clauses of one block, whatever their order here; clauses that exclude each other are an error."""
        names = set(clauses)
        for a, others in ALONE.items():
            if a in names and others & names:
                raise ValueError(f"{a} excludes {sorted(others & names)}")
        for a in names & {"melt", "dcast"}:
            if RESHAPES & names:
                raise ValueError(f"{a} excludes {sorted(RESHAPES & names)}")
        for a in names & {"cov", "corr", "transpose"}:
            if MATRIX & names:
                raise ValueError(f"{a} excludes {sorted(MATRIX & names)}")
        if "by" in names and not names & {"select", "update", "head", "tail", "dcast", "resample"}:
            raise ValueError("by needs select, update, head or tail")
        if "model" in names and names & (MATRIX | {"rename"}):
            raise ValueError("model excludes other clauses")
        if "where" in names and "update" not in names:
            raise ValueError("a where guard needs an update")
        by, f = clauses.get("by"), self
        if "filter" in names:
            f = f.filter(clauses["filter"])
        if "rename" in names:
            f = f.rename(**clauses["rename"])
        fields = clauses.get("select")
        timed = names & {"window", "resample", "melt", "dcast"}
        if "select" in names and not timed:
            f = f.select(by=by, **fields) if isinstance(fields, dict) else f.select(*fields, by=by)
        if "distinct" in names:
            f = f.distinct(*clauses["distinct"])
        if "update" in names and "window" not in names:
            f = f.update(by=by if not names & {"head", "tail"} else None, where=clauses.get("where"), **clauses["update"])
        if "order" in names and "resample" not in names:
            f = f.order(*clauses["order"])
        if "window" in names:
            f = f.window(clauses["window"], clauses.get("aligned", False), by, fields, clauses.get("update"))
        if "resample" in names:
            f = f.resample(clauses["resample"], by, **fields)
            if "order" in names:
                f = f.order(*clauses["order"])
        if "melt" in names:
            f = f.melt(*clauses["melt"], select=fields)
        if "dcast" in names:
            f = f.dcast(clauses["dcast"], fields, by)
        for name in ("cov", "corr", "transpose"):
            if name in names:
                f = getattr(f, name)()
        for name in ("head", "tail"):
            if name in names:
                group = by if "select" not in names else None
                f = getattr(f, name)(clauses[name], group, clauses.get("order"))
        if "model" in names:
            return f.model(**clauses["model"])
        return f


def as_timeframe(frame: Frame | DataFrame, column: str, zone: str | None = None, ties: str = "position", check: bool = False) -> Frame:
    """A frame with a time index: a timestamp, a date, or a long column of nanoseconds.

    ties: whether rows of equal time see only earlier ones in the frame's order in time windows
    ("position"), or each other ("peers"). Null times are an error as soon as a window or resample
    meets them; check runs a job that refuses them here.
    """
    frame = frame if isinstance(frame, Frame) else Frame(frame)
    kind = frame.df.schema[column].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.LongType)):
        raise TypeError(f"{column} is no time column")
    if check and frame.df.where(F.col(column).isNull()).head(1):
        raise ValueError(f"{column} has nulls")
    return replace(frame, time_index=column, zone=zone, ties=ties, order_by=frame.order_by or (column,))


def in_timezone(frame: Frame, zone: str) -> Frame:
    """The same instants, labelled with a zone that resample reads."""
    return replace(frame, zone=zone)


def rbind(*frames: Frame) -> Frame:
    """All rows; a time frame if all are time frames over one column."""
    index = {f.time_index for f in frames}
    out = Frame(reshape.rbind(*(f.df for f in frames)))
    return replace(out, time_index=index.pop(), order_by=frames[0].order_by) if len(index) == 1 and None not in index else out
