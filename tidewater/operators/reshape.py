"""Reshaping and matrices: melt, dcast, rbind, cov, corr, transpose, matmul, literal tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def melt(df: DataFrame, ids: list[str], measures: list[str] | None = None) -> DataFrame:
    """Long form with columns variable and value; measures must share a type."""
    measures = measures or [c for c in df.columns if c not in ids]
    kinds = {df.schema[c].dataType for c in measures}
    if len(kinds) != 1:
        raise ValueError("melt needs measures of one type")
    return df.unpivot(ids, measures, "variable", "value")


def dcast(df: DataFrame, pivot: str, value: str, by: list[str] | None = None, order: list[str] | None = None, values: list | None = None) -> DataFrame:
    """Wide form: a column for each non-null pivot value, the last row by `order` in each cell.

    Without an order a cell of several rows is an error, raised when the result is read.

    Without `values` the pivot values are found by a job, in order of first appearance if `order`
    is given, else sorted; their number is bounded by spark.sql.pivotMaxValues.
    """
    by = by if by is not None else [c for c in df.columns if c not in (pivot, value)]
    if values is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        first = df.where(F.col(pivot).isNotNull()).groupBy(pivot).agg((F.min(F.struct(*order)) if order else F.min(pivot)).alias("at"))
        values = [r[0] for r in first.orderBy("at").limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError("too many pivot values")
    kind = T.StructType([T.StructField("v", df.schema[value].dataType)])
    several = F.raise_error(F.lit("a cell of dcast has several rows: state their order")).cast(kind)
    cell = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)) if order else F.when(F.count(F.lit(1)) > 1, several).otherwise(F.max(F.struct(F.col(value).alias("v"))))
    wide = df.groupBy(*by).pivot(pivot, values).agg(cell)
    return wide.select(*by, *(F.col(f"`{v}`.v").alias(str(v)) for v in values))


def rbind(*frames: DataFrame) -> DataFrame:
    """All rows, by column name; every frame must have the same names and types."""
    want = {f.name: f.dataType for f in frames[0].schema}
    for f in frames[1:]:
        if {x.name: x.dataType for x in f.schema} != want:
            raise ValueError("rbind needs equal columns")
    return reduce(lambda a, b: a.unionByName(b), frames)


def _numeric(df: DataFrame) -> list[str]:
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and not isinstance(f.dataType, T.DecimalType)]
    if not names:
        raise ValueError("no numeric column")
    return names


def _square(df: DataFrame, entry) -> DataFrame:
    """One aggregation over the pairs, then the matrix as rows."""
    names = _numeric(df)
    one = df.agg(*(entry(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j))
    rows = F.array(*(F.struct(F.lit(a).alias("column"), *(F.col(f"{min(i, j)}_{max(i, j)}").alias(b) for j, b in enumerate(names))) for i, a in enumerate(names)))
    return one.select(F.inline(rows))


def cov(df: DataFrame) -> DataFrame:
    """Sample covariances of the numeric columns, with a label column `column`."""
    return _square(df, lambda a, b: F.covar_samp(a, b))


def corr(df: DataFrame) -> DataFrame:
    """Correlations; a constant column has 1 with itself and 0 with others."""

    def entry(a: str, b: str):
        if a == b:
            return F.lit(1.0)
        flat = (F.coalesce(F.var_samp(a), F.lit(0.0)) == 0) | (F.coalesce(F.var_samp(b), F.lit(0.0)) == 0)
        return F.when(flat, 0.0).otherwise(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)))

    return _square(df, entry)


def transpose(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Columns as rows. A leading string column gives the new names, else they are r0, r1, ... in `order`.

    Bounded by spark.sql.transposeMaxValues rows.
    """
    label = df.columns[0] if isinstance(df.schema[0].dataType, T.StringType) else None
    data = [c for c in df.columns if c != label]
    if len({df.schema[c].dataType for c in data}) != 1:
        raise ValueError("transpose needs data columns of one type")
    most = int(df.sparkSession.conf.get("spark.sql.transposeMaxValues"))
    if label is None:
        if not order:
            raise ValueError("transpose without labels needs an order")
        rows = [r.asDict() for r in df.orderBy(*order).limit(most + 1).collect()]
        names = [f"r{i}" for i in range(len(rows))]
    else:
        rows = [r.asDict() for r in (df.orderBy(*order) if order else df).limit(most + 1).collect()]
        names = [r[label] for r in rows]
        if len(set(names)) != len(names) or None in names:
            raise ValueError("transpose labels must be distinct and not null")
    if len(rows) > most:
        raise ValueError("too many rows to transpose")
    schema = T.StructType([T.StructField("column", T.StringType()), *(T.StructField(n, df.schema[data[0]].dataType) for n in names)])
    return df.sparkSession.createDataFrame([(c, *(r[c] for r in rows)) for c in data], schema)


def matmul(a: DataFrame, b: DataFrame, order_b: list[str], most: int = 1000) -> DataFrame:
    """a (m x k) times b (k x n): b, of at most `most` rows, in order_b, becomes constants of one projection."""
    rows = b.orderBy(*order_b).limit(most + 1).collect()
    left, names = _numeric(a), _numeric(b)
    if len(rows) > most or len(rows) != len(left):
        raise ValueError(f"matmul: {len(left)} columns meet {len(rows)} rows")
    return a.select(*(reduce(lambda x, y: x + y, (F.col(c).cast("double") * F.lit(float(r[n])) for c, r in zip(left, rows, strict=True))).alias(n) for n in names))


def table(spark: SparkSession, columns: dict[str, list] | None = None, rows: int | None = None, schema: str | None = None) -> DataFrame:
    """A literal table of equally long columns, or `rows` rows with a running number as column __seq."""
    if columns is None:
        return spark.range(rows).withColumnRenamed("id", "__seq")
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns of unequal length")
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema or list(columns))


def columns_of(df: DataFrame) -> DataFrame:
    """One column `name` with the column names."""
    return df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")


def rep(df: DataFrame, name: str, x, order: list[str], times: int = 1, each: int = 1, length_out: int | None = None) -> DataFrame:
    """df with a column of x (a column name) repeated: each element `each` times, the whole `times` times, cycled to the rows.

    Rows are numbered in `order`; the number of the source row follows from the row's own, so the
    column is joined by number.
    """
    from pyspark.sql import Window as W

    numbered = df.withColumn("__i", F.row_number().over(W.orderBy(*order)) - 1)
    n = numbered.count()
    if length_out is not None and length_out != n:
        raise ValueError("length_out must be the number of rows")
    source = numbered.select(F.col("__i").alias("__s"), F.col(x).alias(name))
    at = F.expr(f"int((__i % {max(1, n * each * times)}) / {each}) % {max(1, n)}")
    return numbered.withColumn("__s", at).join(source, "__s").drop("__s", "__i")
