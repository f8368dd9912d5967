"""Ranks of many rows without one task for each group: rows are cut into stretches of the order, each ranked by itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import TASK_ROWS, file_rows, spread

#: Rows read from files beyond which ranks are cut into stretches.
CUT_ROWS = 1_000_000
#: Rows looked at for each cut; they only fix how even the stretches are, not the ranks.
LOOKS = 50


@dataclass
class Rank:
    """A rank in groups by keys, each (column, ascending, nulls last). finish makes it from a stretch and what lies ahead of it."""

    groups: list[Column]
    keys: list[tuple[Column, bool, bool]]
    finish: Callable[..., Column]


def cut(df: DataFrame, ranks: list[Rank]) -> tuple[DataFrame, list[Column], list[str]]:
    """df with the columns that the ranks need, the ranks, and the names of those columns."""
    total = file_rows(df) if ranks else 0
    if total <= CUT_ROWS:
        return df, [r.finish() for r in ranks], []
    done: dict[str, int] = {}
    out, extra = [], []
    for r in ranks:
        same = str((r.groups, r.keys))
        if same not in done:
            done[same] = len(done)
            df, names = _stretches(df, r, done[same], total)
            extra += names
        i = done[same]
        out.append(r.finish(*(F.col(f"__{n}{i}") for n in ("cut", "ahead", "levels", "all"))))
    return df, out, extra


def _stretches(df: DataFrame, r: Rank, i: int, total: int) -> tuple[DataFrame, list[str]]:
    """Stretch of each row, rows and different keys of its group in earlier ones, and the group's rows if it lies in several."""
    groups = {f"__g{i}_{j}": g for j, g in enumerate(r.groups)}
    keys = {f"__k{i}_{j}": k for j, (k, _, _) in enumerate(r.keys)}
    df = df.withColumns({**groups, **keys})
    ways = [(n, True, True) for n in groups] + [(n, up, last) for n, (_, up, last) in zip(keys, r.keys, strict=True)]
    names = [n for n, _, _ in ways]
    cuts = max(2, 4 * total // TASK_ROWS)
    sort = [{(True, True): F.asc_nulls_last, (True, False): F.asc_nulls_first, (False, True): F.desc_nulls_last, (False, False): F.desc_nulls_first}[up, last](n) for n, up, last in ways]
    seen = df.select(*names).sample(min(1.0, LOOKS * cuts / total), seed=1).orderBy(*sort).collect()
    edges = seen[len(seen) // cuts :: max(1, len(seen) // cuts)] if seen else []
    bounds = df.sparkSession.createDataFrame([([tuple(x) for x in edges],)], f"b array<{df.select(*names).schema.simpleString()}>")

    def reached(edge: Column) -> Column:
        """Whether the row is at the edge or after it."""
        out = F.lit(True)
        for n, up, last in reversed(ways):
            k, b = F.col(n), edge[n]
            null, other = (k.isNull() & b.isNotNull(), k.isNotNull() & b.isNull())
            after = F.coalesce(k > b if up else k < b, F.lit(False)) | (null if last else other)
            before = F.coalesce(k < b if up else k > b, F.lit(False)) | (other if last else null)
            out = F.when(after, True).when(before, False).otherwise(out)
        return out

    steps = F.array(*(F.lit(1 << s) for s in reversed(range(max(1, len(edges).bit_length())))))
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(edges)) & reached(F.get("b", at + s - 1)), at + s).otherwise(at))
    df = df.crossJoin(F.broadcast(bounds)).withColumn(f"__cut{i}", place).drop("b")
    per = df.groupBy(*groups, f"__cut{i}").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*keys)).alias("d"))
    w = W.partitionBy(*groups).orderBy(f"__cut{i}").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    per = per.select(*(F.col(g).alias(f"{g}r") for g in groups), F.col(f"__cut{i}").alias("__cut_r"), F.sum("n").over(w).alias(f"__ahead{i}"), F.sum("d").over(w).alias(f"__levels{i}"), F.sum("n").over(whole).alias(f"__all{i}"), F.count(F.lit(1)).over(whole).alias("__pieces"))
    per = per.where("__pieces > 1").drop("__pieces")  # at most two rows for each edge
    on = F.col(f"__cut{i}") == F.col("__cut_r")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}r"))
    df = spread(df, *groups, f"__cut{i}").join(F.broadcast(per), on, "left").drop("__cut_r", *(f"{g}r" for g in groups))
    return df, [*groups, *keys, *(f"__{n}{i}" for n in ("cut", "ahead", "levels", "all"))]
