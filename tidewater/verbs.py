"""Frames by verbs (mutate, summarise, arrange, slice_head, joins, ...) and a notebook magic over them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import Frame, as_timeframe
from .functions import aggregates as agg
from .functions.deferred import Deferred


@dataclass(frozen=True)
class Verbs:
    """A frame with the groups that group_by() states; every verb gives another."""

    frame: Frame
    groups: tuple[str, ...] = ()

    def _with(self, frame: Frame, groups: tuple[str, ...] | None = None) -> Verbs:
        return replace(self, frame=frame, groups=self.groups if groups is None else groups)

    def _keys(self, by) -> list[str] | None:
        keys = ([by] if isinstance(by, str) else list(by)) if by is not None else list(self.groups)
        return keys or None

    # ---- rows and columns

    def filter(self, *tests: Column | Deferred, by=None) -> Verbs:
        """Rows that pass every test; a test of aggregates looks at its group."""
        out = self.frame
        for test in tests:
            if isinstance(test, Deferred) and test.aggregate:
                out = out.update(by=self._keys(by) or [], __keep=test).filter(F.col("__keep"))
                out = out._as(out.df.drop("__keep"))
            else:
                out = out.filter(test)
        return self._with(out)

    def select(self, *names: str, **renamed: str) -> Verbs:
        """Columns, new=old under new names; the groups stay."""
        missing = [g for g in self.groups if g not in names and g not in renamed.values()]
        return self._with(self.frame.select(*missing, *names, **{new: F.col(old) for new, old in renamed.items()}))

    def rename(self, **new_of_old: str) -> Verbs:
        to = {old: new for new, old in new_of_old.items()}
        return self._with(self.frame.rename(**new_of_old), tuple(to.get(g, g) for g in self.groups))

    def relocate(self, *names: str, before: str | None = None, after: str | None = None) -> Verbs:
        """Columns moved to the front, or beside another one."""
        rest = [c for c in self.frame.df.columns if c not in names]
        at = rest.index(before) if before else rest.index(after) + 1 if after else 0
        return self._with(self.frame.select(*rest[:at], *names, *rest[at:]))

    def mutate(self, by=None, **fields) -> Verbs:
        return self._with(self.frame.update(by=self._keys(by), **fields))

    def transmute(self, **fields) -> Verbs:
        out = self.mutate(**fields)
        return out._with(out.frame.select(*self.groups, *(n for n in fields if n not in self.groups)))

    def distinct(self, *names: str) -> Verbs:
        return self._with(self.frame.distinct(*self.groups, *(n for n in names if n not in self.groups)) if names else self.frame.distinct())

    def arrange(self, *keys) -> Verbs:
        """Sorted, nulls last; a key is a name, (name, "desc") or a column."""
        return self._with(self.frame.order(*keys))

    def slice_head(self, n: int, by=None, order=None) -> Verbs:
        return self._with(self.frame.head(n, self._keys(by), order))

    def slice_tail(self, n: int, by=None, order=None) -> Verbs:
        return self._with(self.frame.tail(n, self._keys(by), order))

    # ---- groups

    def group_by(self, *names: str, add: bool = False, **computed) -> Verbs:
        frame = self.frame.update(**computed) if computed else self.frame
        return self._with(frame, (*(self.groups if add else ()), *names, *computed))

    def ungroup(self) -> Verbs:
        return self._with(self.frame, ())

    def summarise(self, by=None, **fields) -> Verbs:
        """A row a group; the last group is taken off."""
        return self._with(self.frame.select(by=self._keys(by), **fields), () if by is not None else self.groups[:-1])

    def count(self, *names: str, wt=None, sort: bool = False, name: str = "n") -> Verbs:
        keys = [*self.groups, *(n for n in names if n not in self.groups)]
        out = self.frame.select(by=keys or None, **{name: agg.count() if wt is None else agg.sum(wt)})
        return self._with(out.order((name, "desc"), *keys) if sort else out)

    def tally(self, wt=None, sort: bool = False, name: str = "n") -> Verbs:
        return self.count(wt=wt, sort=sort, name=name)

    # ---- time

    def as_timeframe(self, column: str, **options) -> Verbs:
        return self._with(as_timeframe(self.frame, column, **options))

    def window(self, duration: str, aligned: bool = False, **fields) -> Verbs:
        return self._with(self.frame.window(duration, aligned, by=self._keys(None), update=fields))

    def resample(self, duration: str, by=None, **fields) -> Verbs:
        return self._with(self.frame.resample(duration, by=self._keys(by), **fields))

    # ---- joins

    def _join(self, other: Verbs | Frame, how: str, by, suffix) -> Verbs:
        right = other.frame if isinstance(other, Verbs) else other
        if by is None and how != "cross":
            by = [c for c in self.frame.df.columns if c in right.df.columns]
        options = {} if how in ("semi", "anti") else {"suffix": suffix}
        return self._with(self.frame.join(right, by, how, **options))

    def inner_join(self, other, by=None, suffix=("_x", "_y")) -> Verbs:
        return self._join(other, "inner", by, suffix)

    def left_join(self, other, by=None, suffix=("_x", "_y")) -> Verbs:
        return self._join(other, "left", by, suffix)

    def right_join(self, other, by=None, suffix=("_x", "_y")) -> Verbs:
        return self._join(other, "right", by, suffix)

    def full_join(self, other, by=None, suffix=("_x", "_y")) -> Verbs:
        return self._join(other, "outer", by, suffix)

    def cross_join(self, other, suffix=("_x", "_y")) -> Verbs:
        return self._join(other, "cross", None, suffix)

    def semi_join(self, other, by=None) -> Verbs:
        return self._join(other, "semi", by, None)

    def anti_join(self, other, by=None) -> Verbs:
        return self._join(other, "anti", by, None)

    # ---- out

    def pull(self, column: str) -> list:
        """One column's values, on the driver."""
        return [r[0] for r in self.frame.df.select(column).collect()]

    def collect(self) -> list:
        return self.frame.df.collect()

    def show_query(self) -> str:
        """The optimised plan."""
        return self.frame.df._jdf.queryExecution().optimizedPlan().toString()


def verbs(table: Frame | DataFrame) -> Verbs:
    return Verbs(table if isinstance(table, Frame) else Frame(table))


def run_cell(line: str, cell: str, names: dict) -> Frame:
    """A cell of SQL over the frames and DataFrames among `names`; a name on the line keeps the result under it."""
    tables = {k: v.frame.df if isinstance(v, Verbs) else v.df if isinstance(v, Frame) else v for k, v in names.items() if isinstance(v, (Verbs, Frame, DataFrame)) and not k.startswith("_")}
    if not tables:
        raise ValueError("there is no frame among the names of the notebook")
    spark = next(iter(tables.values())).sparkSession
    for k, df in tables.items():
        df.createOrReplaceTempView(k)
    out = Frame(spark.sql(cell))
    if line.strip():
        names[line.strip()] = out
    return out


def load_ipython_extension(ip) -> None:
    """%load_ext tidewater.verbs gives the cell magic %%tidewater."""
    ip.register_magic_function(lambda line, cell: run_cell(line, cell, ip.user_ns), "cell", "tidewater")
