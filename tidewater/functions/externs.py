"""A registry of functions from outside: scalar ones, table functions and consumers of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Externs:
    """Functions by name. Scalar ones take whole Arrow batches as pandas series; table functions yield rows."""

    scalars: dict[str, Callable[..., Column]] = field(default_factory=dict)
    tables: dict[str, tuple[object, str]] = field(default_factory=dict)
    consumers: dict[str, Callable[[DataFrame], int]] = field(default_factory=dict)

    def _new(self, name: str) -> None:
        if name in self.scalars or name in self.tables or name in self.consumers:
            raise ValueError(f"there is an extern {name!r}")

    def scalar(self, name: str, f: Callable, returns: str, takes: int = 1) -> None:
        """f: `takes` pandas series to a series of the type `returns`."""
        import pandas as pd

        self._new(name)
        names = [f"x{i}" for i in range(takes)]
        space: dict = {"f": f}
        exec(f"def call({', '.join(names)}):\n    return f({', '.join(names)})", space)  # noqa: S102  pandas UDFs read the number of arguments
        call = space["call"]
        call.__annotations__ = {**dict.fromkeys(names, pd.Series), "return": pd.Series}
        self.scalars[name] = F.pandas_udf(call, returns)

    def table(self, name: str, rows: Callable[..., Iterable[tuple]], returns: str) -> None:
        """rows: plain values to an iterable of rows of the schema `returns`; it runs on executors."""
        self._new(name)

        class Rows:
            def eval(self, *values):
                yield from rows(*values)

        self.tables[name] = (F.udtf(Rows, returnType=returns), returns)

    def consumer(self, name: str, take: Callable[[DataFrame], int]) -> None:
        """take: a table to the number of rows it has taken."""
        self._new(name)
        self.consumers[name] = take

    def call(self, name: str, *columns: str | Column) -> Column:
        """A scalar function over columns."""
        return self.scalars[name](*columns)

    def read(self, spark: SparkSession, name: str, *values) -> DataFrame:
        """The table of a table function for given values."""
        return self.tables[name][0](*(F.lit(v) for v in values))

    def expand(self, df: DataFrame, name: str, *columns: str) -> DataFrame:
        """Each row of df beside the rows that a table function gives for its columns; rows that get none go."""
        spark = df.sparkSession
        spark.udtf.register(f"__extern_{name}", self.tables[name][0])
        return spark.sql(f"SELECT d.*, t.* FROM {{d}} AS d, LATERAL __extern_{name}({', '.join(f'd.`{c}`' for c in columns)}) AS t", d=df)

    def send(self, df: DataFrame, name: str) -> int:
        """Gives a table to a consumer."""
        return self.consumers[name](df)
