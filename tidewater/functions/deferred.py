"""Expressions that become columns only inside a clause, which knows keys, order and window."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from . import durations


@dataclass
class Part:
    """A sliding function that a clause computes before its fields: of rows at most width ticks before."""

    kind: str
    value: Column
    args: tuple
    width: int


@dataclass
class Context:
    """What a clause tells its expressions. mode: "row", "aggregate" or "window"."""

    mode: str = "row"
    by: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    time: str | None = None
    time_kind: str = "timestamp"
    window: str | int | None = None
    aligned: bool = False
    ties: str = "position"
    #: Keys that an earlier clause grouped the rows by; rows beside each other may be of two groups then.
    grouped: tuple[str, ...] = ()
    #: If not None, gets a Part or Rank for each function that the clause computes beforehand; what is built then is only a stand-in.
    seen: list | None = None
    #: The columns of those parts, taken in the order in which they were seen.
    ready: list | None = None

    def guard(self) -> None:
        """Refuses functions of neighbouring rows over rows of several groups."""
        if self.grouped and not self.by:
            raise ValueError(f"the rows are grouped by {list(self.grouped)}: state by=, or the row order anew with ordered()")

    def ticks(self) -> Column:
        """The time index as a whole number: microseconds, or days of a date, or a long column as it is."""
        if self.time is None:
            raise ValueError("a time window needs a time frame: call as_timeframe first")
        t = F.coalesce(F.col(self.time), F.raise_error(F.lit(f"the time index {self.time} has a null")))
        return {"date": F.unix_date(t) if self.time_kind == "date" else t, "long": t}.get(self.time_kind, F.unix_micros(t.cast("timestamp")) if self.time_kind == "timestamp" else t)

    def width(self, d: str) -> int:
        """A duration in ticks."""
        return durations.ticks(d, self.time_kind)

    def part(self, part) -> Column:
        """The column of a part that the clause has computed, or a stand-in while it looks for parts."""
        if self.seen is not None:
            self.seen.append(part)
            return F.lit(None).cast("double")
        if self.ready is None:
            raise ValueError("a sliding function stands in a field of a clause, not inside another one")
        return self.ready.pop(0)

    def ordered(self) -> WindowSpec:
        if not self.order:
            raise ValueError("this function reads row order: state it with order=[...] on the frame")
        self.guard()
        return W.partitionBy(*self.by).orderBy(*self.order)


class Deferred:
    """build(context) gives the column. Arithmetic and comparison give other deferred expressions."""

    aggregate = False
    row_only = False

    def __init__(self, build: Callable[[Context], Column], aggregate: bool = False):
        self.build = build
        self.aggregate = aggregate

    def _with(self, other, op, swap: bool = False) -> Deferred:
        def build(c: Context) -> Column:
            a, b = self.build(c), resolve(other, c)
            return op(b, a) if swap else op(a, b)

        return Deferred(build, self.aggregate or getattr(other, "aggregate", False))

    def map(self, f: Callable[[Column], Column]) -> Deferred:
        """f applied to the column."""
        return Deferred(lambda c: f(self.build(c)), self.aggregate)

    def cast(self, kind: str) -> Deferred:
        return self.map(lambda x: x.cast(kind))

    def isNull(self) -> Deferred:  # noqa: N802
        return self.map(lambda x: x.isNull())

    def isNotNull(self) -> Deferred:  # noqa: N802
        return self.map(lambda x: x.isNotNull())

    def __neg__(self):
        return self.map(operator.neg)

    def __invert__(self):
        return self.map(operator.invert)


def _add_operators() -> None:
    for name in ("add", "sub", "mul", "truediv", "mod", "lt", "le", "gt", "ge", "eq", "ne", "and_", "or_"):
        op, plain = getattr(operator, name), name.strip("_")
        setattr(Deferred, f"__{plain}__", lambda self, other, op=op: self._with(other, op))
        if name in ("add", "sub", "mul", "truediv", "mod", "and_", "or_"):
            setattr(Deferred, f"__r{plain}__", lambda self, other, op=op: self._with(other, op, True))
    Deferred.__hash__ = object.__hash__


_add_operators()


def resolve(e, c: Context) -> Column:
    """The column of an expression: deferred, a column, a column name, or a literal."""
    if isinstance(e, Deferred):
        return e.build(c)
    if isinstance(e, Column):
        return e
    return F.col(e) if isinstance(e, str) else F.lit(e)


def is_aggregate(e) -> bool:
    return isinstance(e, Deferred) and e.aggregate
