"""Joins with declared keys, collisions, null rule, cardinality and choice of match; as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def _key_pairs(on) -> list[tuple[str, str]]:
    if on is None:
        return []
    if isinstance(on, str):
        on = [on]
    return list(on.items()) if isinstance(on, dict) else [(k, k) for k in on]


def join(left: DataFrame, right: DataFrame, on=None, how: str = "inner", where: Column | None = None, suffix: tuple[str, str] | None = None, nulls: str = "never", expect: str | None = None, take: str | None = None, right_order: list | None = None) -> DataFrame:
    """Joins on names, on {left: right} names, or on a condition over F.col("l.x") and F.col("r.y").

    A key of one name appears once, filled from whichever side has it; of two names both stay.
    Other columns of one name are an error unless suffix renames them. nulls: "never" or "equal".
    expect: "1:1", "n:1", "1:n" or "n:n", an error raised while the join runs if it does not hold.
    take: "first", "last" (by right_order) or "any", one match for each left row.
    """
    if how not in KINDS:
        raise ValueError(f"no join kind {how!r}")
    pairs = _key_pairs(on)
    if how == "cross" and (pairs or where is not None):
        raise ValueError("a cross join takes no keys and no condition")
    if how != "cross" and not pairs and where is None:
        raise ValueError("a join needs keys or a condition")
    same = [a for a, b in pairs if a == b]
    one_sided = how in ("semi", "anti")
    clash = [c for c in left.columns if c in right.columns and c not in same]
    if clash and not one_sided:
        if suffix is None:
            raise ValueError(f"both sides have {clash}: give a suffix")
        names = [c + suffix[0] if c in clash else c for c in left.columns], [c + suffix[1] if c in clash else c for c in right.columns]
        whole = names[0] + [c for c in names[1] if c not in same]
        if len(set(whole)) != len(whole):
            raise ValueError("the suffixes leave equal names")
    else:
        names = list(left.columns), list(right.columns)
    l, r = left.alias("l"), right.alias("r")
    equal = (lambda a, b: a.eqNullSafe(b)) if nulls == "equal" else (lambda a, b: a == b)
    condition = where
    for a, b in pairs:
        test = equal(F.col(f"l.`{a}`"), F.col(f"r.`{b}`"))
        condition = test if condition is None else condition & test
    if how == "cross":
        if expect or take:
            raise ValueError("a cross join takes no expect and no take")
        joined = l.crossJoin(r)
        return joined.select(*(F.col(f"l.`{c}`").alias(n) for c, n in zip(left.columns, names[0], strict=True)), *(F.col(f"r.`{c}`").alias(n) for c, n in zip(right.columns, names[1], strict=True)))
    if one_sided:
        if expect or take:
            raise ValueError("semi and anti joins take no expect and no take")
        return l.join(r, condition, KINDS[how])
    if take or expect:
        l = left.withColumn("__lid", F.monotonically_increasing_id()).alias("l")
        r = right.withColumn("__rid", F.monotonically_increasing_id()).alias("r")
    joined = l.join(r, condition, KINDS[how])
    out = [(F.coalesce(F.col(f"l.`{c}`"), F.col(f"r.`{c}`")) if c in same and how in ("right", "outer") else F.col(f"l.`{c}`")).alias(n) for c, n in zip(left.columns, names[0], strict=True)]
    out += [F.col(f"r.`{c}`").alias(n) for c, n in zip(right.columns, names[1], strict=True) if c not in same]
    if not (take or expect):
        return joined.select(*out)
    extra = [F.col("l.__lid"), F.col("r.__rid")] + ([F.struct(*(F.col(f"r.`{k}`") for k in right_order)).alias("__order")] if right_order else [])
    rows = joined.select(*out, *extra)
    matched = F.col("__lid").isNotNull() & F.col("__rid").isNotNull()
    if expect:
        sides = {"1:1": ("__lid", "__rid"), "n:1": ("__lid",), "1:n": ("__rid",), "n:n": ()}
        for side in sides[expect]:
            n = F.count(F.when(matched, 1)).over(W.partitionBy(side))
            rows = rows.withColumn("__n", n).where(F.when(matched & (F.col("__n") > 1), F.raise_error(F.lit(f"the join is not {expect}")).cast("boolean")).otherwise(True)).drop("__n")
    if take:
        if take in ("first", "last") and not right_order:
            raise ValueError("take first or last needs right_order")
        key = F.col("__order") if right_order else F.col("__rid")
        order = [key.desc() if take == "last" else key.asc(), F.col("__rid").desc() if take == "last" else F.col("__rid").asc()]
        best = F.row_number().over(W.partitionBy("__lid").orderBy(*order))
        rows = rows.withColumn("__n", best).where(~matched | (F.col("__n") == 1)).drop("__n")
    return rows.drop("__lid", "__rid", "__order")


def asof(left: DataFrame, right: DataFrame, time: str, by: list[str] | None = None, right_time: str | None = None, suffix: tuple[str, str] | None = None, right_order: list[str] | None = None, tolerance: str | None = None) -> DataFrame:
    """Each left row with the latest right row of equal `by` keys whose time is not later; the last of tied ones.

    One shuffle: both sides go into one stream by key and time, and each left row takes the last
    right row before it. Keys with nulls match nothing. tolerance bounds how far back a match lies.
    """
    by, right_time = list(by or []), right_time or time
    own = [c for c in right.columns if c not in by and c != right_time]
    clash = [c for c in own if c in left.columns]
    if clash and suffix is None:
        raise ValueError(f"both sides have {clash}: give a suffix")
    name = {c: c + suffix[1] if c in clash else c for c in own}
    lname = {c: c + suffix[0] if c in clash else c for c in left.columns}
    value = F.struct(F.col(right_time).alias("__t"), *(F.col(c).alias(name[c]) for c in own))
    rrows = right.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col(right_time).alias("__time"), F.lit(0).alias("__side"), (F.struct(*right_order) if right_order else F.struct(F.lit(0))).alias("__seq"), value.alias("__r"), F.lit(None).cast(left.schema).alias("__l"))
    lrows = left.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col(time).alias("__time"), F.lit(1).alias("__side"), F.lit(None).cast(rrows.schema["__seq"].dataType).alias("__seq"), F.lit(None).cast(rrows.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    keys = [f"__k{i}" for i in range(len(by))]
    w = W.partitionBy(*keys).orderBy("__time", "__side", "__seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rrows.unionByName(lrows).withColumn("__m", F.last("__r", True).over(w)).where(F.col("__side") == 1)
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull()
    if tolerance is not None:
        from tidewater.functions.durations import nanos

        bad = bad | (F.unix_micros(F.col("__time").cast("timestamp")) - F.unix_micros(F.col("__m.__t").cast("timestamp")) > nanos(tolerance) // 1000)
    found = F.when(~bad, F.col("__m"))
    return rows.select(*(F.col(f"__l.`{c}`").alias(lname[c]) for c in left.columns), *(found[name[c]].alias(name[c]) for c in own))


def scalar(df: DataFrame, column: str):
    """The one non-null value of a one-row table."""
    rows = df.select(column).take(2)
    if len(rows) != 1 or rows[0][0] is None:
        raise ValueError("scalar() needs exactly one row with a value")
    return rows[0][0]


def with_scalar(df: DataFrame, sub: DataFrame, column: str, name: str, on=None) -> DataFrame:
    """df with an aggregate of another table as a column: the same for all rows, or per key (correlated)."""
    pairs = _key_pairs(on)
    if not pairs:
        # the first of at most two rows: a table of several is an error when the result is read
        two = sub.select(F.col(column).alias(name)).limit(2)
        one = two.agg(F.count(F.lit(1)).alias("__n"), F.first(name).alias(name))
        several = F.raise_error(F.lit("a scalar subquery has several rows")).cast(sub.schema[column].dataType)
        return df.crossJoin(F.broadcast(one.select(F.when(F.col("__n") > 1, several).otherwise(F.col(name)).alias(name))))
    sub = sub.select(*(F.col(b).alias(f"__s_{b}") for _, b in pairs), F.col(column).alias(name))
    condition = [df[a] == sub[f"__s_{b}"] for a, b in pairs]
    return df.join(sub, condition, "left").drop(*(f"__s_{b}" for _, b in pairs))
